import math
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from starweave.llm import toxicity


def brute(words):
    """Evidence by plain dictionaries of whole strings; words: (word, toxic) of the counted rows."""
    tops = lambda w: [f" {w} "[max(0, i - 7) : i + 1] for i in range(1, len(w) + 2)]
    seen, total, kinds = (defaultdict(lambda: [0, 0]) for _ in range(3))
    for w, toxic in words:
        for s in tops(w):
            kinds[s[:-1]][1 - toxic] += seen[s][1 - toxic] == 0
            seen[s][1 - toxic] += 1
            total[s[:-1]][1 - toxic] += 1
    low, low_total, low_kinds = defaultdict(int), defaultdict(int), defaultdict(int)
    for x in {s[-n:] for s in seen for n in range(2, len(s) + 1)}:
        low[x[1:]] += 1
    for x, n in low.items():
        low_total[x[:-1]] += n
        low_kinds[x[:-1]] += 1

    def one(s):
        p = 1 / toxicity.SYMBOLS
        for n in range(1, len(s)):
            x = s[-n:]
            if x[:-1] in low_total:
                p = (max(low.get(x, 0) - 0.75, 0) + 0.75 * low_kinds[x[:-1]] * p) / low_total[x[:-1]]
        q = []
        for c in (0, 1):
            t = total[s[:-1]][c] if s[:-1] in total else 0
            n = seen[s][c] if s in seen else 0
            q.append((max(n - 0.75, 0) + 0.75 * kinds[s[:-1]][c] * p) / t if t else p)
        return math.log(q[0]) - math.log(q[1])

    return lambda w: sum(map(one, tops(w)))


def test_strings_keep_their_own_counts_whatever_their_number(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE", 40_000, raising=False)  # several slices, more than a worker holds
    monkeypatch.setattr(toxicity, "HELD", 1, raising=False)
    rng = np.random.default_rng(5)
    random = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 10)))
    rows = [(k, [random() for _ in range(50)]) for k in range(1200)]
    part = {k: zlib.crc32(str(k).encode()) % 4 for k, _ in rows}
    labels = [(k, int(k % 3 == 0)) for k, _ in rows]
    of = brute([(w, t) for (k, ws), (_, t) in zip(rows, labels) if part[k] < 2 for w in ws])
    asked = [ws[0] for _, ws in rows] + [random() for _ in range(1500)]
    docs = spark.createDataFrame([(k, " ".join(ws)) for k, ws in rows] + [(9000 + k, w) for k, w in enumerate(asked)], "doc_id long, text string")
    known, _ = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id - 9000: r.strongest for r in toxicity.evidence(docs.where(F.col("doc_id") >= 9000), known).collect()}
    assert len(got) == len(asked)
    wrong = [w for k, w in enumerate(asked) if abs(got[k] - math.log1p(max(0.0, of(w)))) > 1e-5]
    assert wrong == []
