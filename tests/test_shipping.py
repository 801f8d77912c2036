"""The UDFs reach Python workers that cannot import this package."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from ruleloom.functions.similarity import token_set_ratio
from ruleloom.operators.match import best_match
from ruleloom.operators.screen import screen
from ruleloom.plans.samples import workbook_bytes
from ruleloom.sources.lines import decoded_files, split_lines
from ruleloom.sources.workbook import workbook_rows
df = spark.createDataFrame([("small ring",), ("red bolt",)], "v string")
print(screen(df, [("v", "fuzzy", "similar", "small rings", "0.8")], hits_only=True).count())
print(screen(df, [("v", "fuzzy", "similar", "small rings", "0.8")], audit=True).collect()[0]["_cond_1_match"])
print(screen(df, [("v", "text", "contains", w) for w in ["red", *map(str, range(80))]], hits_only=True).count())
print(df.select(token_set_ratio(F.col("v"), F.lit("ring small"))).first()[0])
reqs = spark.createDataFrame([("small ring", "smallring", "", i) for i in range(3)], "name string, norm string, code string, req_idx long")
print(best_match(df, "v", reqs).collect()[0]["_score"])
files = spark.createDataFrame([("f", bytearray("中".encode("gbk")))], "_source_file string, content binary")
print(split_lines(decoded_files(files)).first()["line"])
books = spark.createDataFrame([("b", bytearray(workbook_bytes({"S": [["h"], ["x"]]})))], "path string, content binary")
print(workbook_rows(books).first()["h"])
"""


def test_from_another_folder(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT, root], cwd=tmp_path, capture_output=True, text=True, timeout=300, env=_environment()
    )
    assert run.stdout.split("\n")[:7] == ["1", "True", "1", "1.0", "0.95", "中", "x"], run.stderr[-2000:]


def _environment():
    import os

    return {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
