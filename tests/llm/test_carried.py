import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from driftloom.llm import langid, quality, recurrent, toxicity
docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text number "), "id").alias("text"), F.lit("en").alias("lang"), F.lit(30).alias("n_chars"))
odd = docs.limit(3).withColumn("text", F.lit(bytearray(b"ab \\xff\\xc3 cd")).cast("string"))
docs = docs.unionByName(odd)
labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"), (F.col("doc_id") % 2).alias("quality")).dropDuplicates(["doc_id"])
every = F.lit(True)
print(langid.identified(docs.drop("lang"), langid.fit(docs, every)).count())
print(quality.scored(docs, quality.fit(docs, labels, every)).where("score >= 0").count())
print(toxicity.scored(docs, toxicity.fit(docs, labels, every)).where("score >= 0").count())
print(recurrent.likelihoods(docs.select("doc_id", "text"), every).where("score <= 0").count())
"""


def test_models_reach_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["63"] * 4, done.stderr[-3000:]
