"""Bench: model build, batch prediction (both algorithms, cold and warm),
accuracy, perplexity, statistics and the sweep at $BENCH_SF_DIR on
local[$BENCH_CPUS].  Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from glossa.operators.split import test_lines  # noqa: E402
from glossa.plans.build import build_model  # noqa: E402
from glossa.plans.evaluate import accuracy_top_n, model_stats, perplexity, sweep  # noqa: E402
from glossa.plans.predict import predict  # noqa: E402
from glossa.session import get_session  # noqa: E402
from glossa.sources.corpus import conversation_phrases, document_lines, read_table  # noqa: E402


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", max(cpus, 8))
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    times = {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    # one row group at this size: spread the documents before they are cleaned
    lines = document_lines(read_table(spark, sf_dir, "documents").repartition(2 * cpus))
    model = timed("build_model", lambda: build_model(lines))
    phrases = conversation_phrases(read_table(spark, sf_dir, "conversations"))
    n_phr = phrases.count()

    def run_predict(algo):
        return predict(model, phrases, algo, 10, clean=True).agg(F.count(F.lit(1))).first()[0]

    for algo in ("stupid", "katz"):
        timed(f"predict_{algo}", lambda a=algo: run_predict(a))  # with the tables that are made once for a model
        timed(f"predict_{algo}_warm", lambda a=algo: run_predict(a))
    test = test_lines(lines)
    timed("accuracy_top_n", lambda: accuracy_top_n(model, test, (1, 3, 5)).collect())
    timed("perplexity", lambda: perplexity(model, test).collect())
    timed("model_stats", lambda: model_stats(model).collect())
    timed("sweep_sizes", lambda: sweep(lines, with_accuracy=False).collect())
    timed("sweep", lambda: sweep(lines, test).collect())  # sizes and accuracies of all 24 configurations
    total = round(sum(times.values()), 3)
    out = {"metric": "ngram_pipeline_total", "value": total, "unit": "sec", "queries": times,
           "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
           "phrases": n_phr, "vocab": model.vocab_size}
    for algo in ("stupid", "katz"):
        for warm in ("", "_warm"):
            out[f"phrases_per_sec_{algo}{warm}"] = round(n_phr / times[f"predict_{algo}{warm}"], 1)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
