"""Documents with hot anchors are found without moving the texts of all."""

import hashlib

from pyspark.sql import functions as F

from tidewell.llm import op3_suffix_dedup as op3


def test_few_documents_with_hot_anchors_are_broadcast(spark, monkeypatch):
    passage = " ".join(hashlib.md5(b"p%d" % i).hexdigest()[:7] for i in range(14))
    noise = lambda i, j: " ".join(hashlib.md5(b"%d.%d.%d" % (i, j, k)).hexdigest()[:6] for k in range(12))
    rows = [(i, 0, f"{noise(i, 0)} {passage} {noise(i, 1)}") for i in range(40)]
    plans = []
    cut = op3.cut_stretches
    monkeypatch.setattr(op3, "cut_stretches", lambda docs, wanted, length: (plans.append(wanted._jdf.queryExecution().logical().toString()), cut(docs, wanted, length))[1])
    docs = spark.createDataFrame(rows, "doc long, tie long, text string")
    marks = op3.repeated(docs, shard=1000).select("doc", F.explode(F.sequence("lo", "hi")).alias("at")).distinct().collect()
    assert len(plans) == 2 and "Hint" in plans[0].splitlines()[0] and "Hint" not in plans[1].splitlines()[0]
    seen, want = set(), set()
    for doc, _, text in rows:
        for at in range(len(text) - op3.LENGTH + 1):
            s = text[at : at + op3.LENGTH]
            if s in seen:
                want.add((doc, at))
            seen.add(s)
    assert want and {(r.doc, r["at"]) for r in marks} == want
