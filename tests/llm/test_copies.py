"""Operators on copies, against brute force over small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from conftest import words

from pyspark.sql import functions as F

from riskloom.llm.components import connected_components
from riskloom.llm.digests import exact_groups, keep_one
from riskloom.llm.jaccard import jaccard_components
from riskloom.llm.lines import _within, drop_lines, fuzzy_lines, word_blocks
from riskloom.llm.queries import op5_lines
from riskloom.llm.substrings import remaining, remove_repeats


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def roots(nodes, links):
    of = {n: n for n in nodes}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = lower(text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def test_components_of_a_path_a_star_and_a_loop(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    want = roots({x for pair in links for x in pair}, links)
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_against_all_pairs(docs_of, odd_docs, odd_rows, no_docs):
    rows = list(odd_rows)
    base = words(50, 120).split()
    for i in range(30):  # a group whose links depend on how much was changed
        other = list(base)
        for k in range(i):
            other[(k * 13 + i) % 120] = f"new{i}_{k % 7}"
        rows.append((500 + i, " ".join(other)))
    sets = [shingles(t) for _, t in rows]
    links = []
    for x in range(len(rows)):
        for y in range(x):
            overlap = len(sets[x] & sets[y])
            if overlap and 100 * overlap >= 75 * len(sets[x] | sets[y]):
                links.append((x, y))
    of = roots(range(len(rows)), links)
    least = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[of[x]].append(i)
    want = Counter((i, len(sets[x]), min(least[of[x]], default=None)) for x, (i, _) in enumerate(rows))
    got = jaccard_components(docs_of(rows).repartition(4)).collect()
    assert Counter(tuple(r) for r in got) == want
    assert jaccard_components(no_docs).count() == 0


def test_jaccard_links_texts_held_in_longer_ones(docs_of):
    rows = []
    for i in range(120):  # 3 of 4 n-grams, 4 of 5, 6 of 8: the longer text may share by its long block only
        n, more = ((7, 1), (8, 1), (10, 2))[i % 3]
        text = words(9000 + i, n + more, 10**6).split()
        rows += [(1000 + 2 * i, " ".join(text[:n])), (1001 + 2 * i, " ".join(text))]
    for i in range(10):  # a base in versions grown by a fifth to a third, not linked with each other
        base = words(7000 + i, 64, 10**6)
        rows += [(5000 + 10 * i, base)] + [
            (5000 + 10 * i + k, f"{base} {words(7100 + 10 * i + k, 12 + 2 * k, 10**6)}") for k in range(1, 5)
        ]
    sets = [shingles(t) for _, t in rows]
    ids = [i for i, _ in rows]
    of = roots(ids, [
        (ids[x], ids[y]) for x in range(len(rows)) for y in range(x)
        if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])
    ])
    got = jaccard_components(docs_of(rows).repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == of and len(set(of.values())) == 130


def test_repeats_against_all_windows(odd_docs, odd_rows, no_docs):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in odd_rows]
    for i, w in split:
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    want = Counter()
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    untouched, cut = remove_repeats(odd_docs)
    assert Counter(tuple(r) for r in remaining(untouched, cut).collect()) == want
    for row in cut.collect():
        assert all(r["high"] - r["low"] >= 49 for r in row["repeats"])
    assert remaining(*remove_repeats(no_docs)).count() == 0


def test_exact_groups_and_the_one_that_stays(odd_docs, odd_rows, no_docs, docs_of):
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in odd_rows:
        groups[plain(t)].append((-len(t or ""), i is None, i or 0))
    want = set()
    for i, t in odd_rows:
        _, no_id, keep = min(groups[plain(t)])
        keep = None if no_id else keep
        digest = hashlib.sha256(plain(t).encode()).hexdigest()
        want.add((i, keep, len(groups[plain(t)]), i == keep, digest))
    for fan_in in (2, 16):
        got = exact_groups(odd_docs, fan_in=fan_in).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(groups)
    assert exact_groups(no_docs).count() == 0 and keep_one(no_docs).count() == 0
    longest = exact_groups(docs_of([(1, "a b"), (2, "a  b"), (3, "ab")])).where("kept").collect()
    assert [r["doc_id"] for r in longest] == [2]


def test_many_copies_merge_through_every_round(docs_of):
    rows = [(i, "the same text") for i in range(300)] + [(1000 + i, words(i, 5)) for i in range(50)]
    got = exact_groups(docs_of(rows).repartition(37), fan_in=2).where("doc_id < 1000").collect()
    assert len(got) == 300 and {(r["keep_id"], r["group_size"]) for r in got} == {(0, 300)}


def test_fuzzy_lines(docs_of, no_docs):
    line = "The " + words(8, 80)
    edited = line + "s"
    other = words(9, 20)
    rows = [
        (1, f"{line}\n\n---\n{other}"), (2, f"{line.upper()}!\nanother line"), (3, edited), (3, edited),
        (4, None), (5, ""), (None, line), (6, f"{other}\n{other}"), (7, "page 12"), (8, "Page 97"),
    ]
    docs = docs_of(rows).repartition(2)
    got = fuzzy_lines(docs, distance=16, percent=90)
    kept = {(r["doc_id"], r["line_no"]): r["kept"] for r in got.collect()}
    first = {(r["doc_id"], r["line_no"]): (r["first_doc"], r["first_line"]) for r in got.collect()}
    assert kept == {
        (1, 0): True, (1, 3): True, (2, 0): False, (2, 1): True, (3, 0): False, (6, 0): False, (6, 1): False,
        (7, 0): True, (8, 0): False,
    }
    assert first[2, 0] == first[3, 0] == (1, 0) and first[6, 1] == (1, 3)
    texts = {r["doc_id"]: r["text"] for r in drop_lines(docs, got).where("doc_id is not null").collect()}
    assert texts[1] == rows[0][1] and texts[2] == "another line" and texts[6] == "" and texts[4] is None
    assert fuzzy_lines(no_docs).count() == 0


def test_lines_of_texts_that_share_an_id(docs_of):
    line, own = words(8, 30), words(9, 30)
    docs = docs_of([(1, line), (2, line), (2, own), (None, line), (2, None)])
    left = drop_lines(docs, fuzzy_lines(docs)).select("doc_id", "text").collect()
    assert Counter(map(tuple, left)) == Counter([(1, line), (2, ""), (2, own), (None, line), (2, None)])


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_recall_of_lines_within_a_tenth_of_edits(spark, docs_of, tmp_path):
    """By length: one word or letter changed, added or left out, and a tenth of all words
    changed. All pairs are held against the edits of a plain table."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    vocabulary = [word(rng.randrange(4, 8)) for _ in range(3000)]
    rows, kinds = [], {}
    for n in (10, 20, 30, 55, 120):
        for kind in ("word", "letter", "added", "gone", "tenth"):
            for _ in range(12 if n == 120 else 30):
                line = [rng.choice(vocabulary) for _ in range(n)]
                other, at = list(line), rng.randrange(n)
                if kind == "word":
                    other[at] = word(len(line[at]))
                elif kind == "letter":
                    other[at] = ("q" if line[at][0] != "q" else "z") + line[at][1:]
                elif kind == "added":
                    other.insert(at, word(3))
                elif kind == "gone":
                    del other[at]
                else:
                    for i in rng.sample(range(n), n // 10):
                        other[i] = word(len(line[i]))
                x, y = " ".join(line), " ".join(other)
                if x == y or 10 * edits(x, y) > max(len(x), len(y)):
                    continue
                kinds[len(rows)] = (n, kind)
                rows += [(len(rows), x), (len(rows) + 1, y)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["first_doc"] for r in op5_lines(spark, str(tmp_path)).collect()}
    pairs = Counter(kinds.values())
    linked = Counter(kind for i, kind in kinds.items() if got[i + 1] == got[i])
    share = {kind: linked[kind] / pairs[kind] for kind in pairs}
    assert all(i == got[i] for i in kinds)  # none is linked with another pair's line
    by_length = {n: [sum(c[k] for k in pairs if k[0] == n) for c in (linked, pairs)] for n in {k[0] for k in pairs}}
    assert all(10 * found >= 9 * of for found, of in by_length.values()), (by_length, share)
    assert all(found >= 0.85 for found in share.values()), share


def test_edits_of_lines_with_words_left_out_at_both_ends(spark):
    rng = random.Random(5)
    pairs = [("a b", "a b c"), ("a b", "a a b"), ("b", "a b"), ("a", "b"), ("ab cd", "abcd"), ("a b c", "b c a")]
    for _ in range(150):
        x = [rng.choice("abcd") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 7))]
        y = list(x)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(2)] = [rng.choice("abcd") * rng.randrange(1, 3)] * rng.randrange(2)
        if y and x != y:
            pairs.append((" ".join(x), " ".join(y)))
    got = spark.createDataFrame(pairs, "x string, y string").selectExpr("*", "explode(sequence(0, 8)) AS most")
    for r in got.withColumn("ok", _within(F.col("most"))).collect():
        assert r["ok"] == (edits(r["x"], r["y"]) <= r["most"]), r


def test_lines_that_share_small_blocks_only(docs_of):
    """Two words of which one changes a letter, and long lines with one word in each of
    their common blocks."""
    vocabulary = [w + e for w in ("internationalisation", "counterrevolutionary", "uncharacteristically", "incomprehensibility")
                  for e in ("", "abc", "def", "ghi")]
    pairs = [(f"{x} {y}", f"{x} {y[:-1]}q") for x in vocabulary for y in vocabulary if x != y]
    rows = [(i, line) for i, line in enumerate(sum(pairs, ()))]
    got = {r["doc_id"]: r["first_doc"] for r in fuzzy_lines(docs_of(rows)).collect()}
    linked = sum(got[2 * i] == got[2 * i + 1] for i in range(len(pairs)))
    assert linked > 0


def test_no_block_is_left_out(spark):
    lines = ["alpha beta", "alpha beta gamma delta epsilon", "one"]
    rows = spark.createDataFrame(list(enumerate(lines)), "line_id long, plain string")
    held = {r["line_id"]: r["count"] for r in word_blocks(rows, 90).groupBy("line_id").count().collect()}
    hashes = [r["h"] for r in spark.sql(f"SELECT explode(split('{lines[1]}', ' ')) AS w").select(F.xxhash64("w").alias("h")).collect()]
    # three and four blocks, of which each holds a word or more
    assert held[1] == sum(len({h % n for h in hashes}) for n in (3, 4)) and held[0] >= 2 and 2 not in held
