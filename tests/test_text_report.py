"""Token sequences as texts against plain loops."""

import math
import random
from collections import Counter

import pytest

from visitframe.operators import textsim

PAD = 0


def plain(train, other):
    """The metrics of aligned lists of token lists, padding removed."""
    train, other = ([[t for t in s if t != PAD] for s in side] for side in (train, other))
    pairs = list(zip(other, train))

    def grams(s, n):
        return Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1))

    def rouge(n):
        total = 0.0
        for p, r in pairs:
            a, b = grams(p, n), grams(r, n)
            both = sum(a.values()) + sum(b.values())
            total += 2 * sum((a & b).values()) / both if both else 0.0
        return total / len(pairs)

    def bleu():
        shares = []
        for n in range(1, 5):
            hit = sum(sum((grams(p, n) & grams(r, n)).values()) for p, r in pairs)
            every = sum(sum(grams(p, n).values()) for p, _ in pairs)
            shares.append(hit / every if every else 0.0)
        c, r = sum(len(p) for p, _ in pairs), sum(len(r) for _, r in pairs)
        return 0.0 if min(shares) == 0 else min(1.0, math.exp(1 - r / c)) * math.exp(sum(map(math.log, shares)) / 4)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        return new

    def drift():
        docs = [Counter(str(t) for t in s if t > 9) for s in train]
        df = Counter(w for d in docs for w in d)
        idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}

        def mean(side):
            out = Counter()
            for s in side:
                d = Counter(str(t) for t in s if t > 9 and str(t) in idf)
                norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in d.items()))
                for w, n in d.items():
                    out[w] += n * idf[w] / norm / len(side)
            return out

        a, b = mean(train), mean(other)
        return math.sqrt(sum((a[w] - b[w]) ** 2 for w in idf) / len(idf))

    rouge_l = sum(2 * lcs(p, r) / (len(p) + len(r)) if p or r else 0.0 for p, r in pairs) / len(pairs)
    return {"rouge1": rouge(1), "rouge2": rouge(2), "bleu": bleu(), "tfidf_rmse": drift()}, rouge_l


@pytest.mark.parametrize("width", [3, 4096])
def test_report_is_that_of_plain_loops(spark, width):
    rng = random.Random(5)

    def some(n, longest):
        return [[rng.choice([1, 2, 11, 12, 13, 14]) for _ in range(rng.randint(1, longest))] + [PAD] * rng.randint(0, 2) for _ in range(n)]

    sides = {"train": some(12, 30), "val": some(9, 20), "syn": some(14, 40)}
    frames = {}
    for name, seqs in sides.items():
        rows = [(10 * i, p, t) for i, s in enumerate(seqs) for p, t in enumerate(s)]
        rng.shuffle(rows)
        frames[name] = spark.createDataFrame(rows, "seq long, pos long, token_id int")
    texts = textsim.SequenceTexts(frames, PAD, width)
    got = {(r["against"], r["metric"]): r["value"] for r in textsim.text_report(texts).collect()}
    for name in ("val", "syn"):
        want, longest = plain(sides["train"], sides[name])
        assert {m: got[name, m] for m in want} == pytest.approx(want)
        assert texts.rouge_l(name).first()["f"] == pytest.approx(longest)
