"""The prefix trie against plain dictionaries of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from riskloom.llm import prefixes
from riskloom.llm.prefixes import placed_turns, rebuilt_trie

TURNS = "conv_id long, turn long, role string, text string, depth long, x string, block long, words long"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: [t for _, t in sorted(ts, key=lambda t: t[0])] for c, ts in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = tuple(own.get(head, [])[:h] + turns[h:])
    members, children, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
        ends[turns].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        spared = (len(convs) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += spared
            leaves[node[:d]] += not children[node]
    return sorted(str((
        min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), leaves[node],
        saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
    )) for node, convs in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def chats_of(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 7, "x", 9, 1) for r in rows], TURNS).repartition(3)

    return make


def found(chats, **options):
    return sorted(str(tuple(r)) for r in rebuilt_trie(chats, **options).select(*COLUMNS).collect())


def made(seed, convs=60, most=14, texts=3, ids=400):
    rng = random.Random(seed)
    said = ["yes it is", "no", "", None, "a  b\\tc\u00a0d"][:texts]
    rows = []
    for c in rng.sample(range(-ids // 4, ids), convs):
        shape = rng.random()
        for t in range(rng.randint(1, most)):
            text = said[0] if shape < 0.4 else rng.choice(said)
            rows.append((c, None if rng.random() < 0.03 else t, rng.choice(["user", "user", None]) if shape > 0.8 else "user", text))
    return rows


@pytest.mark.parametrize(("seed", "block_turns"), [(1, 4), (2, 1), (3, 3)])
def test_against_brute_force(chats_of, seed, block_turns):
    rows = made(seed, texts=2 + seed % 4, ids=60 if seed % 2 else 400)
    assert found(chats_of(rows), block_turns=block_turns) == brute(rows)


def test_runs_of_any_length(chats_of, monkeypatch):
    monkeypatch.setattr(prefixes, "_RUN", 2)
    monkeypatch.setattr(prefixes, "_IDS", 3)
    rows = made(6, most=40) + [(c, t, "user", "same") for c in range(1000, 1040) for t in range(9)]
    assert found(chats_of(rows)) == brute(rows)


def test_a_long_conversation_is_numbered_across_ranges(spark, chats_of):
    rows = [(7, t, "user", f"t {t}") for t in range(5000)] + [(c, t, "user", "t 0") for c in range(30) for t in range(2) if c != 7]
    placed = placed_turns(chats_of(rows)).where("conv_id = 7").orderBy("place").collect()
    assert [r["place"] for r in placed] == list(range(5000))
    assert found(chats_of(rows[4000:])) == brute(rows[4000:])


def test_odd_rows(chats_of):
    rows = [
        (None, 0, "user", "nobody"), (1, None, None, None), (1, None, "user", "x"), (1, 5, "user", "x"), (1, 5, "user", "x"),
        (20, 0, "", ""), (21, 0, None, None), (21, 1, "user", "tie"), (21, 1, "bot", "tie"), (21, 1, "user", "other"),
        (-3, 0, "user", "below zero"), (0, 0, "user", "head"), (40, 0, "user", "long " * 50_000), (55, 0, "user", "only"),
    ]
    assert found(chats_of(rows)) == brute(rows)
    turnless = [(c, 0, "user", "gone") for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4]
    assert found(chats_of(turnless)) == brute(turnless) and len(brute(turnless)) == 1


def test_no_rows(chats_of):
    assert rebuilt_trie(chats_of([])).count() == 0
    assert rebuilt_trie(chats_of([(None, 1, "user", "x")])).count() == 0


def test_hot_conversations_share_one_delegate(chats_of):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(5)]
    assert found(chats_of(rows)) == brute(rows)
    groups = prefixes._groups
    seen = []

    def counted(blocks, block_turns):
        out = groups(blocks, block_turns)
        seen.append(out.agg(F.max("members"), F.count("*")).first())
        return out

    prefixes._groups = counted
    try:
        rebuilt_trie(chats_of(rows)).count()
    finally:
        prefixes._groups = groups
    assert seen[0][0] > 60 and seen[0][1] < 30
