"""Small tables of documents with the awkward cases, and plain code that the operators must equal."""
from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed: int, n: int) -> str:
    """``n`` invented words, the same for the same seed."""
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i * seed) % 997}" for i in range(n))


def awkward_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empties, ties, repeats and a very long text."""
    shared = prose(5, 120)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "one two"), (7, "ONE two"),
        (8, prose(1, 300)), (9, prose(1, 300)), (9, prose(1, 300)), (10, prose(1, 299) + "  x"),
        (11, prose(2, 80) + " " + shared), (12, shared + "\n" + prose(3, 70)), (13, "start " + shared + " end"),
        (14, " ".join(["again"] * 400)), (15, "Lé café \U0001f600 naïve\n\nline\nline\r\nline"), (16, prose(9, 20000)),
        (17, prose(1, 300).replace("w5 ", "v5 ", 1)), (None, prose(1, 300)), (None, None), (18, "\x00\x0b\x0c"),
    ]
    sources = [None, "b", "a", "c"]
    return [(i, text, None if k % 5 == 0 else "en", sources[k % 4], None) for k, (i, text) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows=None, parts: int = 3):
    """A table of documents with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA).repartition(parts)
    names = ("id", "score", "kept", "sig", "key", "block", "place", "size", "taken", "anchor")
    names += ("column_0", "__id", "__place", "__times", "__digest", "__length", "__copies", "__turn", "_part")
    return df.withColumns({name: F.lit(f"clash {name}") for name in names})


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None, k: int) -> set[tuple[str, ...]]:
    w = words((text or "").translate(LOWER))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def linked_components(rows: list[tuple], k: int, percent: int) -> list[tuple]:
    """(doc_id, size of the set, smallest id reachable) by comparing all pairs."""
    sets = [shingles(row[1], k) for row in rows]
    root = list(range(len(rows)))

    def find(a: int) -> int:
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    members = defaultdict(list)
    for a in range(len(rows)):
        members[find(a)].append(rows[a][0])
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in members.items()}
    return [(rows[a][0], len(sets[a]), least[find(a)]) for a in range(len(rows))]


def without_repeats(rows: list[tuple], window: int = 50) -> list[tuple]:
    """(doc_id, words, removed, digest of the kept words) by a table of all windows."""
    first: dict[tuple, float] = {}
    order = lambda i: float("inf") if i is None else i
    for row in rows:
        w = words(row[1])
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, float("inf")), order(row[0]))
    out = []
    for row in rows:
        w = words(row[1])
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < order(row[0]):
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((row[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def rule_counts(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) word by word."""
    text = text or ""
    w = words(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts = Counter(grams)
    cover = {i + j for i, g in enumerate(grams) if counts[g] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(cover)


def ordered(rows) -> list[tuple]:
    """Rows as sorted tuples, nulls last."""
    return sorted((tuple(row) for row in rows), key=lambda row: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in row))
