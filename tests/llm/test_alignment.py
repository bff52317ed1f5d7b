"""Aligned tokens against a plain two-pointer walk, with both libraries used as they are."""

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import words

from riskloom.llm import alignment
from riskloom.llm.alignment import TOKENIZER_A, TOKENIZER_B, align, common_ends, diagonals
from riskloom.storage import WIDE_ROWS, store

pytestmark = pytest.mark.skipif(not Path(TOKENIZER_A).exists(), reason="tokenizer files not present")
ODD = [
    "a  b\n\n c\td  ", "\nword", " ", "  \n", "<|endoftext|> and </s><unk>", "café 世界 \U0001f600\U0001f469‍\U0001f52c",
    "it's we'll 12,345.6 ... ---", "x y　z w", "a▁b ▁", "l\r\nm \r\n n", "a\x0bb\x1cc\x85d", "©© ﬁ Ａ",
    "nul \x00 sign", "=" * 3000, " " * 500 + "end", "สวัสดี नमस्ते", "abc" * 700,
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(TOKENIZER_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER_B)
    alphabet = alignment._byte_alphabet()
    a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    b_bytes = [
        bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in enumerate(b.id_to_piece(list(range(b.get_piece_size()))))
    ]

    def encode(text):
        if not text:
            return [], []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        x, y = [(i, a_bytes[i]) for i in x], [(i, b_bytes[i]) for i in y]
        whole = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else ([], [])

    return encode


def groups_of(x, y):
    groups, i, j, a, b, ends = [], 0, 0, [], [], [0, 0]
    while i < len(x) or j < len(y):
        if j == len(y) or i < len(x) and ends[0] <= ends[1]:
            a.append(x[i][0])
            ends[0] += len(x[i][1])
            i += 1
        else:
            b.append(y[j][0])
            ends[1] += len(y[j][1])
            j += 1
        if ends[0] == ends[1]:
            groups.append((a, b))
            a, b = [], []
    return groups


def brute(rows, encode):
    found = []
    for doc_id, text in rows:
        x, y = encode(text)
        found.append((doc_id, len(x), len(y), groups_of(x, y)))
    links = [Counter((a, b) for g in groups for a in g[0] for b in g[1]) for *_, groups in found]
    counts = Counter(pair for own in links for pair in own)
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for (doc_id, n_a, n_b, groups), own in zip(found, links, strict=True):
        written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append(str((
            doc_id, n_a, n_b, len(groups), sum(own.values()), hashlib.sha256(written.encode()).hexdigest() if groups else "",
            sum(n for (a, b), n in own.items() if counts[a, b] == best[a]), sum(n * counts[p] for p, n in own.items()),
        )))
    return sorted(out)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def found(docs):
    return sorted(str(tuple(r)) for r in align(docs).select(*COLUMNS).collect())


@pytest.mark.parametrize(("piece", "block", "kept"), [(1 << 15, 3 << 20, 300_000), (64, 3 << 20, 300_000), (7, 300, 3), (1000, 4000, 50)])
def test_against_the_libraries(docs_of, odd_rows, libraries, monkeypatch, piece, block, kept):
    rng = random.Random(3)
    made = ["".join(rng.choice("ab '\n\t.,1é世 e") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(ODD + made + ODD[:3])]
    rows = [(i, t if t is None or len(t) < 20_000 else t[:5000]) for i, t in rows]
    original = alignment._encode

    def patched(models):
        inner = original(models)

        def run(batches):
            from riskloom.llm import alignment as there

            there.PIECE, there.BLOCK_BYTES, there.KEPT_RUNS = piece, block, kept
            yield from inner(batches)

        return run

    monkeypatch.setattr(alignment, "_encode", patched)
    assert found(docs_of(rows).repartition(3)) == brute(rows, libraries)


def test_a_wide_group_is_counted_by_different_ids():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 7, 200)
    keys, times = alignment._links(a, b, np.array([300]), np.array([200]), np.array([0]))
    want = Counter((int(x), int(y)) for x in a for y in b)
    assert {(int(k) >> 20, int(k) & (1 << 20) - 1): int(n) for k, n in zip(keys, times, strict=True)} == want


@pytest.mark.parametrize("piece", [1, 2, 5, 100])
def test_diagonals_cut_equal_work(piece):
    rng = np.random.default_rng(piece)
    for _ in range(50):
        a, b = (np.unique(rng.integers(1, 60, rng.integers(0, 30))) for _ in range(2))
        i, j = diagonals(a, b, piece)
        assert i[-1] == len(a) and j[-1] == len(b)
        assert (np.diff(i + j) <= piece + 1).all()
        for p, q in zip(i, j, strict=True):
            assert not (p and q < len(b)) or a[p - 1] < b[q]
            assert not (q and p < len(a)) or b[q - 1] < a[p]
        assert common_ends(a, b, piece).tolist() == np.intersect1d(a, b).tolist()


def test_texts_are_encoded_run_by_run():
    with open(TOKENIZER_A, "rb") as a, open(TOKENIZER_B, "rb") as b:
        encoders = alignment.Encoders(a.read(), b.read(), alignment.PATTERN)
    assert encoders.by_runs
    encoders.places(["one two  one", "rare\rspace"])
    assert set(encoders.known) == {" one", " two", "  one"}


def test_no_rows(no_docs):
    assert align(no_docs).count() == 0


def test_repeated_texts_count_as_documents(docs_of):
    text = words(5, 40)
    rows = align(docs_of([(1, text), (1, text), (None, text)])).collect()
    assert len({(r["n_best"], r["count_sum"]) for r in rows}) == 1
    assert rows[0]["count_sum"] == 3 * rows[0]["n_links"]


def test_pieces_are_merged_one_at_a_time(spark):
    models = alignment.Models(spark, TOKENIZER_A, TOKENIZER_B, alignment.PATTERN)
    block = alignment._aligned_block(models.encoders(), [7, 8], [words(i, 16_000) for i in (1, 2)])
    pieces = block.column("pieces")[0].values
    batch = pa.RecordBatch.from_struct_array(pieces)
    batch = batch.append_column("block", pa.array([0] * len(pieces), pa.int64()))
    assert len(pieces) > 3
    assert [b.num_rows for b in alignment._merge_pieces(models)([batch])] == [1] * len(pieces)


def test_no_task_holds_lists_of_several_blocks(docs_of):
    plan = align(docs_of([(1, "one text")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_wide_rows_are_stored_in_small_groups(spark):
    rows = spark.range(0, 12, 1, 1).selectExpr("id", "transform(sequence(1, 500000), i -> xxhash64(id, i)) AS numbers")
    (file,) = Path(store(rows, **WIDE_ROWS).removeprefix("file:")).glob("*.parquet")
    assert pq.ParquetFile(file).num_row_groups > 1
