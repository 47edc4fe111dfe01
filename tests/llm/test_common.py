import glob
import time

from pyspark.sql import functions as F

from plumbline.llm.common import cut


def test_cut_leaves_no_shuffle_files(spark):
    folders = [str(f) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f for folder in folders for f in glob.glob(f"{folder}/*/shuffle_*")}
    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    counted = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    until = time.time() + 20  # files are removed behind the query
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert counted.agg(F.sum("n")).first()[0] == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
