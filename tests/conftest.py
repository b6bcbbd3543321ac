import gc
import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


# One session runs some thousands of jobs.  Spark's status store would keep 100,000 tasks and 1,000 plans of
# them, in the heap, though no page shows them; and a JVM that runs out of it ends, with all tests behind it.
KEEP = {"spark.ui.retainedTasks": "2000", "spark.ui.retainedStages": "100", "spark.ui.retainedJobs": "100",
        "spark.sql.ui.retainedExecutions": "20", "spark.sql.streaming.ui.retainedQueries": "5",
        "spark.sql.codegen.cache.maxEntries": "200"}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession
    died = tmp_path_factory.mktemp("jvm") / "hs_err.log"
    b = (SparkSession.builder.master("local[4]").appName("propwise-tests")
         .config("spark.driver.memory", "3g")
         .config("spark.driver.extraJavaOptions", f"-XX:ErrorFile={died}")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true"))
    for k, v in KEEP.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    from propwise.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    yield s


def held(s) -> dict:
    """What the session holds after a collection: MB of heap, persisted frames, threads."""
    gc.collect()
    jvm = s._jvm
    jvm.System.gc()
    run = jvm.java.lang.Runtime.getRuntime()
    return {"heap_mb": (run.totalMemory() - run.freeMemory()) >> 20, "persisted": s.sparkContext._jsc.getPersistentRDDs().size(),
            "threads": jvm.java.lang.management.ManagementFactory.getThreadMXBean().getThreadCount()}


@pytest.fixture(scope="module", autouse=True)
def tidy(request):
    """No module leaves frames behind; with HELD_LOG set, a line for each module says what the session holds."""
    yield
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    if s is None:
        return
    s.catalog.clearCache()
    if os.environ.get("HELD_LOG"):
        with open(os.environ["HELD_LOG"], "a") as f:
            print(request.module.__name__, held(s), file=f)


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="propwise-test-")
