"""Operators on single texts: phrases, toxicity, tokens, chats, URLs, the mix."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from conftest import words

from riskloom.llm import chat, lengths, toxicity
from riskloom.llm.mixing import mix_sources, word_count
from riskloom.llm.positional import contamination, phrase_matches
from riskloom.llm.urls import judge_urls
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def test_phrases_against_brute_force(spark, docs_of, odd_rows, no_docs):
    items = [
        (1, words(2, 30)), (2, "short Item!"), (3, None), (4, "..."), (5, words(1, 13)), (None, words(1, 20)),
        (10, "never seen " + words(77, 20)), (12, words(1, 200)),
    ]
    rows = [*odd_rows, (60, "a SHORT, item and short-item"), (61, words(2, 12)), (62, words(8, 300) + " " + words(2, 13))]
    windows = {}
    for i, t in items:
        w = item_words(t)
        for k in range(max(1, len(w) - 12)):
            if w and i is not None:
                windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = Counter()
    for i, t in rows:
        w, hit, found = item_words(t), set(), set()
        for window, ids in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found |= ids
        listed = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        want[i, len(w), len(hit), len(found), listed, bool(hit) and 20 * len(hit) >= len(w)] += 1
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(rows).repartition(3)
    got = contamination(phrase_matches(docs, benchmark)).drop("spans", "items")
    assert Counter(tuple(r) for r in got.collect()) == want
    none = contamination(phrase_matches(docs, benchmark.where("false"))).collect()
    assert len(none) == len(rows) and not any(r["contaminated"] for r in none)
    assert phrase_matches(no_docs, benchmark).count() == 0


def test_blocks_of_items_give_the_same(spark, docs_of, odd_rows, monkeypatch):
    items = spark.createDataFrame([(i, words(2, 40 + i)) for i in range(6)], "item_id long, text string")
    docs = docs_of(odd_rows)
    key = lambda r: (str(r["doc_id"]), r["n_hit"], r["n_items"], r["items_sha256"])
    whole = sorted(map(key, contamination(phrase_matches(docs, items)).collect()))
    monkeypatch.setattr("riskloom.llm.positional.BLOCK_WORDS", 60)
    assert sorted(map(key, contamination(phrase_matches(docs, items)).collect())) == whole


def test_proximity(spark, docs_of):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = docs_of([(1, "alpha beta gamma delta"), (2, "alpha x beta gamma delta"), (3, "alpha x x x beta gamma delta")])
    near = {r["doc_id"]: r["items"] for r in phrase_matches(docs, items, window=4, slop=1).collect()}
    assert near == {1: [1], 2: [1], 3: []}


@pytest.fixture(scope="module")
def toxic_tables(spark, docs_of):
    insults = ["numbskull", "blockhead", "dunderhead"]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        w = words(i, 30).split()
        if toxic:
            w[5] = insults[i // 4 % 3]
        rows.append((i, " ".join(w) + " the numbers block under skull headed"))
        labels.append((i, 1, int(toxic)))
    rows += [
        (5000, "you numb5ku11 there"), (5001, "you b l o c k h e a d"), (5002, "dunderrrrrheaaad"),
        (5003, "kind words only"), (5004, ""), (5005, None), (None, "such a numbskull"), (5006, "x" * 200_000),
    ]
    labels += [(None, 1, 1), (3, 1, None), (99999, 0, 1)]
    return docs_of(rows).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_finds_disguised_words(toxic_tables):
    docs, labels = toxic_tables
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(got) == 1208
    wrong = [i for i in range(1200) if got[i]["predicted"] != (i % 4 == 0)]
    assert len(wrong) < 12
    assert [got[i]["predicted"] for i in (5000, 5001, 5002, None)] == [1, 1, 1, 1]
    assert [got[i]["predicted"] for i in (5003, 5004, 5005, 5006)] == [0, 0, 0, 0]
    assert got[5004]["score"] == got[5005]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[None]["held_out"] is False


@pytest.fixture(scope="module")
def english():
    text = "you are a stupid fool and he is an ass with a pigs poop on the boss of all this glass in a class there "
    other = "so what can we do about it when they say that the rest was not as good as he had said it would be "
    return toxicity.Restorer(toxicity.letter_model(letters_of([text * 20 + other * 20])))


def letters_of(texts):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    return next(toxicity._count_letters(iter([batch]))).to_pandas()


@pytest.mark.parametrize("disguised, word", [
    (" ".join("youareastupidfoolandheisanasswithpoop"), "fool"),  # several words set apart
    (" ".join("youareastupidfool" * 40), "fool"),
    ("st" + "u" * 60 + "pid", "stupid"),
    ("f" + "0" * 50 + "l", "fool"),
    ("a s s", "ass"), ("p o o p", "poop"), ("a$$", "ass"), ("you a$$!", "ass"),
])
def test_disguises_of_any_length_are_read(english, disguised, word):
    text = f"he said {disguised} there"
    assert word in re.split(r"\W+", toxicity.restore(pa.array(["plain", text, "words"]), english)[1].as_py())


def test_plain_ends_of_sentences_stay(english):
    for text in ("what a good class!", "the rest was good!!", "is that so! can we say so!", "all of 20$ there", "1 2 3", "1 1 1 1"):
        assert english.text(text) == text


def test_rows_that_may_be_disguised_are_all_found():
    rng = random.Random(3)
    alphabet = ["a", "a", "\u00e9", "\u00c9", "\u044f", "\u4e2d", "\u212a", "k", "$", "!", "1", "0", " ", " ", "-", "_", ".", "\u201c", "\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(20_000)]
    texts += ["\u00e9 a b", "a \u00e9 b c", "a b \u4e2d", "\u00c9\u00e9\u00c9", "x", "a b c", None, "a s s"]

    def plain(text):
        tokens = [t for t in re.findall(r"(?:[^\W_]|[@$!|+])+", text) if len(t) > 2 and any(c.isalpha() for c in t)]
        return not toxicity._APART.search(text) and not any(toxicity._HINT.search(t) for t in tokens)

    found = set(toxicity._maybe_disguised(pa.array(texts)).tolist())
    missed = [t for i, t in enumerate(texts) if t and i not in found and not plain(t)]
    assert not missed
    assert any(i not in found for i in range(20_000))


def test_labels_of_held_out_rows_are_not_read(toxic_tables):
    docs, labels = toxic_tables
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda table: sorted((str(r["doc_id"]), r["score"]) for r in table.collect())
    assert key(toxicity.toxicity_scores(docs, labels)) == key(toxicity.toxicity_scores(docs, turned))


def test_toxicity_without_labels(toxic_tables, no_docs):
    docs, labels = toxic_tables
    assert {r["score"] for r in toxicity.toxicity_scores(docs, labels.where("false")).collect()} == {0.0}
    assert toxicity.toxicity_scores(no_docs, labels).count() == 0


def test_token_counts_against_a_loop(spark, odd_docs, odd_rows, no_docs):
    counter = lengths.token_counter(spark)
    with open(lengths.TOKENIZER, "rb") as file:
        encode = lengths._encoding(file.read(), lengths.PATTERN).encode_ordinary
    n = [len(encode(t or "")) for _, t in odd_rows]
    sums = lengths.suffix_sums(lengths.length_histogram(odd_docs, counter))
    rows = {r["n_tokens"]: r for r in sums.collect()}
    assert set(rows) == set(n)
    for x, r in rows.items():
        assert r["n_docs"] == n.count(x) and r["docs_at_least"] == sum(y >= x for y in n)
        assert r["tokens_at_least"] == sum(y for y in n if y >= x) and r["docs_at_most"] == sum(y <= x for y in n)
        assert r["tokens_at_most"] == sum(y for y in n if y <= x) and r["truncated_tokens"] == sum(min(x, y) for y in n)
    for r in lengths.at_limits(sums, [0, 10, 255, 256, 257, 10**6]).collect():
        limit = r["context_limit"]
        assert r["docs"] == sum(y <= limit for y in n) and r["truncated_tokens"] == sum(min(limit, y) for y in n)
    half = lengths.quantiles(sums, [0.5]).first()["n_tokens"]
    assert half == sorted(n)[-(-len(n) // 2) - 1]
    assert lengths.suffix_sums(lengths.length_histogram(no_docs, counter)).count() == 0


TURNS = "conv_id long, turn long, role string, text string, states string, valid int"


def test_chats_round_trip(spark):
    hard = ["", None, "\\", "<", "[", "</s>", "[INST]x[/INST]", "<\\", "\\<[", "a\\\\<<[[b", "caf\u00e9 \U0001f600\n", "[ROLE]", "<s><SYS>"]
    turns = [(1, i, role, text) for i, (role, text) in enumerate(
        [("system", "s")] + [(r, t) for t in hard for r in ("user", "assistant")])]
    turns += [(2, 0, "tool]<", "x"), (2, 0, None, "y"), (2, 0, None, "y"), (3, 5, "assistant", "first"), (3, None, "user", "z")]
    turns += [(None, 0, "user", "q"), (4, 0, "user", "u"), (4, 1, "user", "u")]
    table = spark.createDataFrame([(*t, "x", 1) for t in turns], TURNS).repartition(3)
    chats = chat.format_chats(table)
    got = {r["conv_id"]: r for r in chat.chat_digests(chats).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in (1, 2, 3, 4, None):
        rows = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in turns if c == conv))
        said = "".join(x for _, _, r, x in rows if r == "assistant")
        assert got[conv]["n_turns"] == len(rows)
        assert got[conv]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, _, r, x in rows))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), sha(said))
    assert got[1]["valid"] and got[1]["first_fault"] is None
    assert not got[2]["valid"] and got[2]["first_fault"] == 0
    assert got[3]["valid"] and not got[4]["valid"] and got[4]["first_fault"] == 1
    for r in chats.collect():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        for s in r["segments"]:
            if s["content"]:
                assert not re.search(r"[<\[](?!\\)", s["text"])
    assert chat.format_chats(table.where("false")).count() == 0


RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def test_urls(spark):
    known = {
        "https://www.Example.org/en/12?x": ("www.example.org", "/en/12", "example.org/en/1", "block"),
        "http://notexample.org/en/12": ("notexample.org", "/en/12", "org/", "allow"),
        "http://example.org/es/": ("example.org", "/es/", "example.org/es/", "block"),
        "http://a.com/de/#f": ("a.com", "/de/", "com/de/", "block"),
        "http://a.com/fr/x://y": ("a.com", "/fr/x://y", "com/fr/", "allow"),
    }
    free = {
        "http://a.org": ("a.org", ""), "http://a.com/en/1": ("a.com", "/en/1"), "x": ("", ""), "": ("", ""),
        "http://a.com:80/de/": ("a.com:80", "/de/"), "http://\u00c4B.net?/de/": ("\u00c4b.net", ""), "//a.com/de/": ("", ""),
    }
    urls = [*known, *free, None] + [f"http://h{i}.com/{'de' if i % 2 else 'fr'}/{i}{'9' * (i % 2 * 20)}" for i in range(200)]
    pages = spark.createDataFrame([(i, u, 1.0, 2) for i, u in enumerate(urls)], "page_id long, url string, label double, depth int")
    got = {urls[r["page_id"]]: r for r in judge_urls(pages.repartition(3), RULES).collect()}
    assert len(got) == len(urls)
    for u, want in known.items():
        assert tuple(got[u])[1:5] == want
    for u, want in free.items():
        assert tuple(got[u])[1:4] == (*want, None) and got[u]["verdict"] in ("allow", "block")
    assert tuple(got[None])[1:4] == ("", "", None)
    assert {r["verdict"] for r in judge_urls(pages, ()).collect()} == {"allow"}
    assert judge_urls(pages.where("false"), RULES).count() == 0
    labelled = spark.createDataFrame(
        [(f"http://a{i}.net/{'9' * 20 if i % 2 else 'abc'}", i % 2) for i in range(400)], "url string, label int")
    learnt = judge_urls(spark.createDataFrame([(1, "http://b.net/" + "9" * 20), (2, "http://b.net/abc")], "page_id long, url string"), (), labelled)
    assert {r["page_id"]: r["verdict"] for r in learnt.collect()} == {1: "block", 2: "allow"}


def test_word_count(spark):
    texts = [None, "", " \t\n", "a", " a  b\x0bc ", "a\u00a0b c"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(word_count(F.col("text")).alias("n"))
    assert [r["n"] for r in rows.collect()] == [len((t or "").encode().split()) for t in texts]


def test_mix_moves_shortages_to_siblings_first(spark):
    rows = []
    # domain a: english is short, german has plenty; domain b has plenty
    for i in range(20):
        rows.append((i, "w " * 10, "en", "s1", "a"))
    for i in range(20, 400):
        rows.append((i, "w " * 10, "de", f"s{i % 2}", "a"))
    for i in range(400, 1000):
        rows.append((i, "w " * 10, "en", "s9", "b"))
    rows += [(1000, None, "en", "s9", "b"), (1001, "", None, None, None), (None, "w w", "en", "s9", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string").repartition(3)
    mix = mix_sources(docs, 4000, domain=F.col("domain"), weights={"domain": {"a": 1, "b": 1, "": 0}}, max_epochs=2, seed=3)
    got = mix.groupBy("domain", "lang").agg(F.sum("n_tokens").alias("n")).collect()
    n = {(r["domain"], r["lang"]): r["n"] for r in got}
    # half of 4000 each; English gives its 400 (two passes), German takes the other 1600
    assert n["a", "en"] == 400 and 1570 <= n["a", "de"] <= 1600 and 1990 <= n["b", "en"] <= 2000
    again = mix_sources(docs.repartition(5), 4000, domain=F.col("domain"), weights={"domain": {"a": 1, "b": 1, "": 0}}, max_epochs=2, seed=3)
    key = lambda t: sorted(map(str, t.collect()))
    assert key(mix) == key(again)
    other = mix_sources(docs, 4000, domain=F.col("domain"), weights={"domain": {"": 0}}, max_epochs=2, seed=4)
    assert key(mix) != key(other)
    twice = mix.where("lang = 'en' and domain = 'a'").groupBy("doc_id").count().collect()
    assert {r["count"] for r in twice} == {2} and len(twice) == 20
    everything = mix_sources(docs, 10**9, domain=F.col("domain"), max_epochs=1)
    assert everything.where("n_tokens > 0").count() == 1001
    assert mix_sources(docs.where("false"), 100).count() == 0
