import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from psephos.llm import ctw
from tests.llm.cases import LOWER, SCHEMA, awkward_rows, prose, table, words


def byte_sequence(text):
    return (" ".join(words((text or "").translate(LOWER))) + "\n").encode()


class PlainTree:
    """Context-tree weighting by recursion over dictionaries."""

    def __init__(self, texts):
        self.counts = defaultdict(lambda: [0, 0])
        self.below = defaultdict(set)
        for text in texts:
            for context, byte in self.pairs(text):
                for node, bit in self.path(byte):
                    for d in range(ctw.DEPTH + 1):
                        self.counts[context[:d], node][bit] += 1
                        if d:
                            self.below[context[: d - 1], node].add(context[:d])
        self.known = {}

    @staticmethod
    def pairs(text):
        data = b"\n" * ctw.DEPTH + byte_sequence(text)
        for i in range(ctw.DEPTH, len(data)):
            yield data[i - ctw.DEPTH : i][::-1], data[i]

    @staticmethod
    def path(byte):
        node = 1
        for j in range(7, -1, -1):
            bit = byte >> j & 1
            yield node, bit
            node = node * 2 + bit

    def estimate(self, context, node):
        a, b = self.counts.get((context, node), (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log(self, context, node):
        if (context, node) not in self.known:
            own = self.estimate(context, node)
            if len(context) < ctw.DEPTH:
                below = sum(self.log(c, node) for c in self.below.get((context, node), ()))
                own = np.logaddexp(own, below) - math.log(2)
            self.known[context, node] = own
        return self.known[context, node]

    def one(self, context, node):
        sure, left, rate = 0.0, 1.0, 0.5
        for d in range(ctw.DEPTH + 1):
            a, b = self.counts.get((context[:d], node), (0, 0))
            if not a + b:
                return sure + left * rate
            rate = (b + 0.5) / (a + b + 1)
            w = 1.0 if d == ctw.DEPTH else math.exp(self.estimate(context[:d], node) - math.log(2) - self.log(context[:d], node))
            sure, left = sure + left * w * rate, left * (1 - w)
        return sure

    def score(self, text):
        total = 0.0
        for context, byte in self.pairs(text):
            for node, bit in self.path(byte):
                p = self.one(context, node)
                total += math.log10(p if bit else 1 - p)
        return total


def some_rows():
    rows = [r[:2] for r in awkward_rows() if len(r[1] or "") < 3000]
    return rows + [(200 + i, prose(i, 20 + i)) for i in range(12)] + [(300, "held out wörds ß"), (301, "w5 w6 zzz")]


def is_held(doc_id):
    return doc_id is not None and doc_id % 3 == 0


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(i, t, None, None, None) for i, t in some_rows()]
    df = table(spark, rows).selectExpr("*", "doc_id % 3 = 0 AS held")
    found = ctw.score(df, held_out="held").collect()
    return sorted(found, key=lambda r: (r["id"] is None, r["id"] or 0, r["n_tokens"]))


def test_scores_equal_a_recursive_tree(scores):
    tree = PlainTree([t for i, t in some_rows() if not is_held(i)])
    wanted = sorted(some_rows(), key=lambda r: (r[0] is None, r[0] or 0, len(words(r[1]))))
    for row, (i, text) in zip(scores, wanted, strict=True):
        assert row["id"] == i
        assert row["score"] == pytest.approx(tree.score(text), rel=1e-5)
        assert row["bits_per_byte"] == pytest.approx(-row["score"] / math.log10(2) / len(byte_sequence(text)))


def test_word_scores_equal_plain_counts(scores):
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
    counts = Counter(w for i, t in some_rows() if not is_held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    wanted = sorted(some_rows(), key=lambda r: (r[0] is None, r[0] or 0, len(words(r[1]))))
    for row, (i, text) in zip(scores, wanted, strict=True):
        own = tokens(text)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert row["held_out"] == is_held(i)
        assert row["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))


def test_bytes_after_a_context_add_up_to_one():
    tree = PlainTree([prose(3, 60), "ab ab ab"])
    for context in (b"\n\n\n\n\n", b" ba b", b"5w 4w", b"zzzzz"):
        total = 0.0
        for byte in range(256):
            p = 1.0
            for node, bit in tree.path(byte):
                one = tree.one(context, node)
                p *= one if bit else 1 - one
            total += p
        assert total == pytest.approx(1)


def test_log_gamma():
    z = np.concatenate([np.arange(0.5, 40, 0.5), [1e3, 1e6 + 0.5, 1e12]])
    assert ctw.log_gamma(z) == pytest.approx([math.lgamma(x) for x in z], rel=1e-12, abs=1e-9)


def test_many_blocks_and_chunks(spark, monkeypatch, scores):
    """However the texts are cut into blocks, the scores stay."""
    rows = [(i, t, None, None, None) for i, t in some_rows()]
    df = table(spark, rows, parts=9).selectExpr("*", "doc_id % 3 = 0 AS held")
    found = ctw.score(df, held_out="held").collect()
    left = sorted((str(r["id"]), r["n_tokens"], round(r["score"], 3)) for r in found)
    assert left == sorted((str(r["id"]), r["n_tokens"], round(r["score"], 3)) for r in scores)


def test_nothing_to_learn_from(spark, nothing):
    df = spark.createDataFrame([(3, "ab", None, None, None), (6, None, None, None, None)], SCHEMA).selectExpr("*", "true AS held")
    found = {r["id"]: r for r in ctw.score(df, held_out="held").collect()}
    assert found[3]["score"] == pytest.approx(24 * math.log10(0.5), rel=1e-5)
    assert (found[3]["base_score"], found[3]["n_known"], found[3]["train_tokens"]) == (0.0, 0, 0)
    assert found[6]["n_tokens"] == 1
    assert ctw.score(nothing).count() == 0
