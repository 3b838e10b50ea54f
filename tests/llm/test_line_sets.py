"""Sets of lines: characters beyond the 16-bit range, lines of null and empty texts."""

import random

from pyspark.sql import functions as F

import brute
from filarium.llm import line_dedup


def test_last_character_of_a_word_beyond_16_bits_counts(spark):
    """Every one of 13 to 40 characters changes the set, also where the line has two-unit characters."""
    words = ["".join(chr(0x1F600 + i * 7 % 60) if i % 3 else chr(97 + i % 26) for i in range(n)) for n in (13, 14, 24, 25, 40)]
    rows = [(k, i, w[:i] + "§" + w[i + 1:]) for k, w in enumerate(words) for i in range(len(w))] + [(k, -1, w) for k, w in enumerate(words)]
    sets = {(r.k, r.i): frozenset(r.s) for r in spark.createDataFrame(rows, "k int, i int, x string").select(
        "k", "i", line_dedup.shingles(F.col("x")).alias("s")).collect()}
    assert [key for key in sets if key[1] >= 0 and sets[key] == sets[key[0], -1]] == []


def test_lines_of_null_and_empty_texts(spark):
    lines = line_dedup.split_lines(spark.createDataFrame([(1, "a b\n \nc"), (2, None), (3, "")], "doc_id long, text string"))
    assert sorted((r.doc_id, r.line_no, r.line) for r in lines.collect()) == [(1, 0, "a b"), (1, 2, "c")]


def test_long_words_are_compared_whole(spark):
    """Lines of long words count by all runs of 12 characters in them, six to the weight of a word's end."""
    r = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    texts = []
    for k in range(120):
        x = "".join(r.choice(letters) for _ in range(r.randint(13, 160))) + (" and a few words behind" if k % 3 == 0 else "")
        at = r.randrange(1, len(x))
        texts += [x, x[:at] + "".join(r.choice(letters) for _ in range(r.randint(1, max(1, len(x) // 9)))) + x[at:]]

    def weights(x):
        out = {}
        for m in brute.WORD.finditer(x):
            w = m.group()
            out.update({x[m.start():m.start() + 12]: 6, w[-12:] if len(w) > 12 else x[m.start():m.start() + 12]: 6})
            out.update({("in", w[i:i + 12]): 1 for i in range(len(w) - 11 if len(w) > 12 else 0)})
        return out

    sets, want, near = [weights(x) for x in texts], set(), 0
    for k in range(0, len(texts), 2):
        a, b = sets[k], sets[k + 1]
        shared = sum(v for s, v in a.items() if s in b)
        union = sum(a.values()) + sum(b.values()) - shared
        want |= {k + 1} if shared >= 0.8 * union else set()
        near += 0.7 * union < shared < 0.9 * union
    got = line_dedup.line_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    gone = {g.doc_id for g in got.collect() if not g.kept}
    assert near >= 20 and gone <= want and len(gone) >= 0.97 * len(want) and 20 < len(want) < 100, (near, len(want), len(gone))
