"""Derived test inputs on the driver tables (see FIXTURES.md).

The Spark side builds each fixture with the DataFrame API; the DuckDB side
(oracle) uses the portable SQL text below.  Both follow the same arithmetic in
the same order, so doubles agree bit for bit.  The modulo rules here *generate*
the dirty/skewed shapes of listings and events; they never subset rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed listing per order: 25 areas (nations), dirty nulls, skewed prices."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_linestatus")
    q = li.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qt"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(F.lit(0.0))).alias("qo"),
    )
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    base = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(q, q.l_orderkey == o.o_orderkey, "left")
    )
    return base.select(
        ok.alias("listing_id"),
        F.col("n_name").alias("lokasi"),
        F.when(ok % 97 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("o_totalprice") * 1000 * (1 + (ck % 10) * (ck % 10) / F.lit(4.0)))
        .alias("harga"),
        (1 + ok % 7 + F.when(ok % 53 == 0, 5).otherwise(0)).cast("int").alias("kamar_tidur"),
        (1 + ck % 5).cast("int").alias("kamar_mandi"),
        F.when(ok % 83 == 0, 0).otherwise((ok * 7) % 5).cast("int").alias("garasi"),
        F.col("qt").alias("luas_tanah"),
        F.col("qo").alias("luas_bangunan"),
        F.col("o_orderdate").alias("created_at"),
    )


def listings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as scraped text: price words, units, junk and aliased headers."""
    l = listings(spark, sf_dir)
    lid, h = F.col("listing_id"), F.col("harga")

    def int_text(c: Column) -> Column:
        return c.cast("bigint").cast("string")

    price_text = (
        F.when(h.isNull(), F.lit(None).cast("string"))
        .when(lid % 89 == 0, F.lit("Nego"))
        .when(lid % 79 == 0, F.lit("Rp 1.250.000.000"))
        .when(h >= 1e9, F.concat(
            F.lit("Rp "), int_text(F.floor(h / 1e9)), F.lit(","),
            F.lpad((F.floor(h / 1e7).cast("bigint") % 100).cast("string"), 2, "0"), F.lit(" Miliar")))
        .when(h >= 1e6, F.concat(F.lit("Rp "), int_text(F.floor(h / 1e6)), F.lit(" Juta")))
        .otherwise(int_text(F.floor(h)))
    )
    return l.select(
        lid.alias("listing_id"),
        F.col("lokasi").alias("kecamatan"),
        (lid % 40).cast("int").alias("page"),
        price_text.alias("harga"),
        F.when(lid % 71 == 0, F.lit("n/a")).otherwise(F.col("kamar_tidur").cast("string")).alias("kamar_tidur"),
        F.col("kamar_mandi").cast("string").alias("kamar_mandi"),
        F.when(lid % 83 == 0, F.lit(None).cast("string")).otherwise(F.col("garasi").cast("string")).alias("garasi"),
        F.when(F.col("luas_tanah").isNull(), F.lit(None).cast("string"))
        .otherwise(F.concat(int_text(F.col("luas_tanah")), F.lit(" m2"))).alias("luas_tanah"),
        F.when(F.col("luas_bangunan").isNull(), F.lit(None).cast("string"))
        .otherwise(F.concat(int_text(F.col("luas_bangunan")), F.lit(" m2"))).alias("luas_bangunan"),
        F.col("created_at"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One correction per event; some violate the price floor on purpose."""
    e = table(spark, sf_dir, "events")
    eid, uid, v = F.col("event_id"), F.col("user_id"), F.col("value")
    return e.select(
        eid.alias("feedback_id"),
        F.concat(F.lit("NATION_"), (uid % 25).cast("string")).alias("lokasi"),
        (1 + eid % 6).cast("int").alias("kamar_tidur"),
        (1 + uid % 4).cast("int").alias("kamar_mandi"),
        (eid % 4).cast("int").alias("garasi"),
        (40 + eid % 200).cast("double").alias("luas_tanah"),
        (30 + uid % 150).cast("double").alias("luas_bangunan"),
        (v * 10000000).alias("harga_prediksi"),
        (v * 10000000 * (80 + eid % 41) / 100).alias("harga_asli"),
        F.when(eid % 10 == 0, F.lit("scraped")).otherwise(F.lit("user_feedback")).alias("sumber"),
        (F.col("event_type") == "purchase").alias("processed"),
        F.col("ts").alias("created_at"),
    )


def prediction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON audit payloads of the three prediction topics."""
    e = table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")

    def s(c: Column) -> Column:
        return c.cast("string")

    topic = (F.when(eid % 3 == 0, "property.prediction.regression")
             .when(eid % 3 == 1, "property.prediction.classification")
             .otherwise("property.prediction.clustering"))
    tool = (F.when(eid % 3 == 0, "predict_price").when(eid % 3 == 1, "classify_segment")
            .otherwise("cluster_property"))
    payload = F.concat(
        F.lit('{"tool":"'), tool,
        F.lit('","input":{"lokasi":"NATION_'), s(uid % 25),
        F.lit('","luas_tanah":'), s(40 + uid % 20), F.lit(',"luas_bangunan":'), s(30 + uid % 10),
        F.lit(',"kamar_tidur":'), s(1 + uid % 6), F.lit(',"kamar_mandi":'), s(1 + uid % 4),
        F.lit(',"garasi":'), s(uid % 3), F.lit('},"output":{"harga_estimasi":'),
        s(F.floor(F.col("value") * 100).cast("bigint")),
        F.lit(',"kelas_id":'), s(eid % 4), F.lit(',"cluster_id":'), s(eid % 6),
        F.lit(',"latency_ms":'), s(eid % 50), F.lit("}}"),
    )
    return e.select(eid.alias("event_id"), F.col("ts"), topic.alias("topic"), payload.alias("payload"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in outputs of the two price models (routing/blend/metrics are exact)."""
    l = listings(spark, sf_dir).filter(F.col("harga").isNotNull())
    lid, h = F.col("listing_id"), F.col("harga")
    return l.select(
        lid, F.col("lokasi"), h.alias("harga_asli"),
        (h * (90 + lid % 21) / 100).alias("harga_low"),
        (h * (95 + lid % 11) / 100).alias("harga_high"),
    )


# ---------------------------------------------------------------------------
# DuckDB twins (oracle side).  Same text as FIXTURES.md.

SQL = {
    "listings": """
select o.o_orderkey as listing_id, n.n_name as lokasi,
  case when o.o_orderkey % 97 = 0 then null
       else o.o_totalprice * 1000 * (1 + (o.o_custkey % 10) * (o.o_custkey % 10) / cast(4 as double)) end as harga,
  cast(1 + o.o_orderkey % 7 + case when o.o_orderkey % 53 = 0 then 5 else 0 end as int) as kamar_tidur,
  cast(1 + o.o_custkey % 5 as int) as kamar_mandi,
  cast(case when o.o_orderkey % 83 = 0 then 0 else (o.o_orderkey * 7) % 5 end as int) as garasi,
  q.qt as luas_tanah, q.qo as luas_bangunan, o.o_orderdate as created_at
from orders o
join customer c on o.o_custkey = c.c_custkey
join nation n on c.c_nationkey = n.n_nationkey
left join (select l_orderkey, sum(l_quantity) as qt,
                  sum(case when l_linestatus = 'O' then l_quantity else 0 end) as qo
           from lineitem group by l_orderkey) q on q.l_orderkey = o.o_orderkey""",
    "listings_raw": """
select listing_id, lokasi as kecamatan, cast(listing_id % 40 as int) as page,
  case when harga is null then null
       when listing_id % 89 = 0 then 'Nego'
       when listing_id % 79 = 0 then 'Rp 1.250.000.000'
       when harga >= 1e9 then concat('Rp ', cast(cast(floor(harga / 1e9) as bigint) as string), ',',
            lpad(cast(cast(floor(harga / 1e7) as bigint) % 100 as string), 2, '0'), ' Miliar')
       when harga >= 1e6 then concat('Rp ', cast(cast(floor(harga / 1e6) as bigint) as string), ' Juta')
       else cast(cast(floor(harga) as bigint) as string) end as harga,
  case when listing_id % 71 = 0 then 'n/a' else cast(kamar_tidur as string) end as kamar_tidur,
  cast(kamar_mandi as string) as kamar_mandi,
  case when listing_id % 83 = 0 then null else cast(garasi as string) end as garasi,
  case when luas_tanah is null then null else concat(cast(cast(luas_tanah as bigint) as string), ' m2') end as luas_tanah,
  case when luas_bangunan is null then null else concat(cast(cast(luas_bangunan as bigint) as string), ' m2') end as luas_bangunan,
  created_at
from listings""",
    "feedback": """
select event_id as feedback_id, concat('NATION_', cast(user_id % 25 as string)) as lokasi,
  cast(1 + event_id % 6 as int) as kamar_tidur, cast(1 + user_id % 4 as int) as kamar_mandi,
  cast(event_id % 4 as int) as garasi,
  cast(40 + event_id % 200 as double) as luas_tanah, cast(30 + user_id % 150 as double) as luas_bangunan,
  value * 10000000 as harga_prediksi,
  value * 10000000 * (80 + event_id % 41) / 100 as harga_asli,
  case when event_id % 10 = 0 then 'scraped' else 'user_feedback' end as sumber,
  event_type = 'purchase' as processed, ts as created_at
from events""",
    "prediction_events": """
select event_id, ts,
  case event_id % 3 when 0 then 'property.prediction.regression'
                    when 1 then 'property.prediction.classification'
                    else 'property.prediction.clustering' end as topic,
  concat('{"tool":"', case event_id % 3 when 0 then 'predict_price' when 1 then 'classify_segment' else 'cluster_property' end,
    '","input":{"lokasi":"NATION_', cast(user_id % 25 as string),
    '","luas_tanah":', cast(40 + user_id % 20 as string), ',"luas_bangunan":', cast(30 + user_id % 10 as string),
    ',"kamar_tidur":', cast(1 + user_id % 6 as string), ',"kamar_mandi":', cast(1 + user_id % 4 as string),
    ',"garasi":', cast(user_id % 3 as string), '},"output":{"harga_estimasi":', cast(cast(floor(value * 100) as bigint) as string),
    ',"kelas_id":', cast(event_id % 4 as string), ',"cluster_id":', cast(event_id % 6 as string),
    ',"latency_ms":', cast(event_id % 50 as string), '}}') as payload
from events""",
    "scored": """
select listing_id, lokasi, harga as harga_asli,
  harga * (90 + listing_id % 21) / 100 as harga_low,
  harga * (95 + listing_id % 11) / 100 as harga_high
from listings where harga is not null""",
}

_DEPS = {"listings_raw": ["listings"], "scored": ["listings"]}


def with_fixtures(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies first)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} as ({SQL[n]}\n)" for n in order]
    ctes += [f"{n} as ({q}\n)" for n, q in (extra or [])]
    return ("with " + ",\n".join(ctes) + "\n" + body) if ctes else body
