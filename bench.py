"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Every query is written to Spark's noop sink, so all rows and columns are computed. MB are 10^6 bytes of UTF-8.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.plans import queries as q

HEADLINE = {
    "encode_raw": lambda s, d: q.documents(s, d).select("doc_id", q.raw().encode_col("text")),
    "encode_bytelevel": lambda s, d: q.documents(s, d).select("doc_id", q.mapped().encode_col("text")),
    "encode_sentencepiece": lambda s, d: q.documents(s, d).select("doc_id", q.pieces().encode_col("text")),
    "encode_relational": lambda s, d: q.raw().encode_df(q.documents(s, d), strategy="relational"),
    "encode_with_special": lambda s, d: q.thoughts(s, d).select("turn_id", q.raw().encode_col("text", with_special=True)),
    "split_cl100k": q.queries()["split_cl100k"],
    "split_o200k": q.queries()["split_o200k"],
    "token_count_by_lang": q.token_count_by_lang,
    "token_frequency_topk": q.token_frequency_topk,
    "roundtrip": q.roundtrip,
    "byte_level_encode": q.byte_level_encode,
    "chatml_tokens": q.chatml_tokens,
    "stream_decode": q.stream_decode,
}


def run(df: DataFrame) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.files.maxPartitionBytes": "4m"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    mb = q.table(spark, d, "documents").agg(F.sum(F.octet_length("text"))).first()[0] / 1e6
    run(HEADLINE["encode_raw"](spark, d))  # starts the workers
    times = {name: round(min(run(f(spark, d)) for _ in range(2)), 3) for name, f in HEADLINE.items()}
    rates = {name: round(mb / t, 2) for name, t in times.items() if name.startswith(("encode_raw", "encode_byte", "encode_sen", "encode_rel", "split", "roundtrip"))}
    print(json.dumps({"metric": "encode_raw", "value": times["encode_raw"], "unit": "sec", "queries": times, "sf": d.rpartition("sf")[2], "mb_per_sec": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
