"""Token counts against the library itself, over the table and over odd texts."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from propwise.llm import token_counts
from propwise.llm.queries import TOKENIZER, op11_token_counts

from .test_text_operators import ODD, SCHEMA, SF

PATH = public_tokenizers.path(TOKENIZER)


def library(path, texts):
    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    marks = [0x85, 0xa0, 0x130, 0x131, 0x1c5, 0x300, 0x301, 0x307, 0x345, 0x3a3, 0x3c2, 0x660, 0x1100, 0x1161, 0x11a8,
             0x1f88, 0x2028, 0x2167, 0x200b, 0x3000, 0xac00, 0xfeff, 0x10400, 0x1f600]
    pool = [chr(i) for i in [*range(0x250), *marks]] + [
        "'s", "'re", "'LL", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "ab", "the", " ", "\n", "'"]
    return ["".join(rng.choices(pool, k=rng.randint(0, 14))) for _ in range(n)]


def test_table_equals_the_library(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r.doc_id: (len(r.text.encode()), n, n > 2048) for r, n in zip(rows, library(PATH, [r.text for r in rows]))}
    got = op11_token_counts(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == want and len(got) == len(rows)
    assert 0 < sum(r.n_shortcut for r in got) < sum(r.n_tokens for r in got)


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 as n_tokens", "text as `__text`").repartition(3)
    got = token_counts.count_tokens(docs, PATH, carry=["doc_id", "n_tokens", "lang"])
    assert got.columns == ["doc_id", "lang", "n_bytes", "n_tokens", "over_limit", "n_shortcut"]
    want = sorted((str(r[0]), len((r[1] or "").encode()), n, n > 2048) for r, n in zip(ODD, library(PATH, [r[1] for r in ODD])))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_text_equals_the_library(name):
    import pyarrow as pa

    path = public_tokenizers.path(name)
    texts = [*odd_texts(8_000), "a" * 50_000, "é" * 20_000, "x " * 30_000]
    counter = token_counts.Counter(path, token_counts.prove_whole(path))
    assert counter(pa.array(texts))[0].tolist() == library(path, texts)


def test_every_proven_string_is_one_token_of_the_library():
    lib, proven = Tokenizer.from_file(PATH), token_counts.prove_whole(PATH)
    vocab = lib.get_vocab(with_added_tokens=False)
    # letters and digits stand for themselves in the byte alphabet, so the whole way can be checked
    plain = sorted(w for w in proven if w.isascii() and w.isalpha() and w.islower())
    ids = [e.ids for e in lib.encode_batch(plain, add_special_tokens=False)]
    assert len(plain) > 20_000 and ids == [[vocab[w + "</w>"]] for w in plain]


def test_other_files_are_refused(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    with pytest.raises(ValueError, match="only tokenizer files"):
        token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
