"""Secret scans of texts that are one long candidate, in a process of their own: a stack overflow would end it."""

import os
import subprocess
import sys

SCRIPT = r'''
import base64, random, string, sys
from pyspark.sql import functions as F
from shootlake.llm import secret_scans, stages
from shootlake.session import build_session
spark = build_session("long", "local[2]", **{"spark.ui.enabled": "false", "spark.driver.memory": "4g",
                                            "spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1"})
rng = random.Random(3)
texts = {}
for n in (10**3, 10**4, 10**5, 10**6):
    texts[f"slug {n}"] = ("ab-" * n)[:n - 1] + "z", False
    texts[f"dated {n}"] = "some_identifier_10010x/" * (n // 23), False
    texts[f"humps {n}"] = "Hump" * (n // 4), False
    texts[f"one sign {n}"] = "=" * n, False
    texts[f"letters {n}"] = "k" * n, False
    texts[f"base64 {n}"] = base64.b64encode(rng.randbytes(n * 3 // 4)).decode().rstrip("="), True
rows = [(k, t, s, None, None, len(t)) for k, (t, s) in texts.items()]
docs = spark.createDataFrame(rows, "doc_id string, text string, secret boolean, row int, spans string, n_chars long")
out = stages.mask_secrets(spark, docs, "")
assert out.columns == docs.columns
for r in out.collect():
    assert (r.text == "[SECRET]") == r.secret and r.n_chars == len(r.text), (r.doc_id, r.text[:40])
print("survived")
'''


def test_texts_of_one_candidate():
    done = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, timeout=600,
                          env={**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))})
    assert "survived" in done.stdout, done.stderr[-3000:]
