"""Awkward small tables and plain versions of what the operators compute."""

import hashlib
import re

import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept int, __id string, fp long, `score` string"
LONG = " ".join(f"Word{i % 977} and Ünique{i}" for i in range(6000))
LINE = "a line that is shared by several documents"


def documents(spark, rows):
    """Documents with columns that clash with names the operators use; rows are (doc_id, text, source)."""
    return spark.createDataFrame(
        [(i, t, "en", s, 1, "size", 7, "x", 3, "y") for i, t, s in rows], SCHEMA
    )


AWKWARD = [
    (1, "Hello World Again and again", "a"),
    (2, "hello world again AND again", "b"),
    (2, "hello world again AND again", "b"),
    (3, None, None),
    (4, "", "a"),
    (5, "  \t\n ", "c"),
    (6, LONG, "a"),
    (7, LONG + " tail", "a"),
    (None, "no id here at all", "b"),
    (8, f"First\n  {LINE.upper()} \nÜber Straße ÄÖ\n{LINE}", "b"),
    (9, f"{LINE}\nsecond", "z"),
    (10, f"third\n{LINE}\t", None),
    (11, "ÉTÉ Été ÀB", "d"),
    (12, "Été été Àb".replace("été", "ÉTÉ"), "d"),
]


def low(text):
    return (text or "").translate(LOW)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def simhash(text):
    w = words(text)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def reach(nodes, near):
    """Least node that each can reach, by comparing all pairs."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if near(a, b) and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label
