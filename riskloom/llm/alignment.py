"""Cross-tokenizer alignment: the tokens of two tokenizers over the same bytes.

Both token sequences of a text are ascending lists of byte ends, A and B. Merging the two
lists shows where both end; these common ends cut the text into groups of tokens that
cover the same bytes. Every A token of a group is linked with every B token of it.

The merge is divided by *merge path*: a binary search along each diagonal finds how many
ends of A and how many of B are among the first ``k * PIECE`` of the merged list, so the
pieces between diagonals are independent and of equal work, however unevenly the tokens
lie. Equal ends are kept on one side of a cut. A long text is dealt out piece by piece;
each piece emits the groups inside it and the open tokens at its two sides, and open
sides that meet are stitched into a group.

How often two tokens are linked is counted over all documents. Texts lie in blocks of
some megabytes: a block counts its own documents per pair first, and gets the corpus
counts of its own pairs back, so what is shuffled grows with the different pairs of a
block and not with links. A pair that every document holds is one row a block.

Encoding a text goes run by run: white space and the word after it. Neither tokenizer has
a token that goes on from a word into the white space after it (this is verified for the
pieces of B, and known of the pattern of A), so runs are encoded on their own and the
results kept. Texts with rarer white space are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.lengths import PATTERN
from riskloom.storage import WIDE_ROWS, materialize

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Ends of both sides in a piece; a text with more is dealt out.
PIECE = 1 << 15
#: Bytes of text in a block, about.
BLOCK_BYTES = 3 << 20
#: Runs whose encoding a worker keeps.
KEPT_RUNS = 300_000
#: Groups with more links than this are counted by different ids.
WIDE = 1 << 12

_BITS = 20
_RUN = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+")
#: White space that the tokenizers, or Python, see in different ways.
_RARE = re.compile("[\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　▁]")

_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
BLOCK_SCHEMA = (
    f"docs array<struct<{', '.join(': '.join(c.split()) for c in _DOC.split(', '))}>>, pairs array<long>, "
    "n_docs array<int>, first array<int>, entry array<int>, times array<long>"
)
PIECE_SCHEMA = (
    "doc int, doc_id long, piece int, a array<int>, b array<int>, a_from long, b_from long"
)


def _byte_alphabet() -> dict[str, int]:
    """The signs that byte-level vocabularies write bytes with: printable bytes stand for
    themselves, the others for the signs from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_ranks(model: bytes) -> tuple[dict[bytes, int], dict[int, bytes]]:
    """The tokens of a byte-level vocabulary file (JSON) as bytes, and its special tokens.

    A merge has the rank of the token it makes; that is verified here."""
    data = json.loads(model)
    vocabulary, special = data["model"]["vocab"], {t["id"]: t["content"].encode() for t in data.get("added_tokens", ())}
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in data["model"]["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        raise ValueError("the ids of this vocabulary are not in the order of its merges")
    if not set(alphabet := _byte_alphabet()) <= set(vocabulary):
        raise ValueError("this vocabulary doesn't hold every byte")
    ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if i not in special}
    return ranks, special


class Encoders:
    """Both tokenizers, the bytes of their tokens, and the runs encoded so far."""

    def __init__(self, model_a: bytes, model_b: bytes, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        ranks, special = byte_level_ranks(model_a)
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        named = {i: token for token, i in ranks.items()} | special
        self.a_bytes = [named.get(i, b"") for i in range(max(named) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        self.space = self.b.piece_to_id("▁")
        # pieces never go on from a word into white space, nor from a space to a line end;
        # the pattern cuts A's texts there before it looks at tokens
        self.by_runs = pattern == PATTERN and not any(
            re.search("[^▁ \n\t\r][▁ \n\t]|▁[\n\t]", p) for p in pieces
        )
        numbers = max(len(self.a_bytes), len(self.b_bytes))
        self.written = [b"%d%s" % (i, sign) for i in range(numbers) for sign in (b",", b"|", b";", b"")]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.a_ids, self.b_ids = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.a_first, self.b_first = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.right = np.zeros(0, bool)

    def _add(self, texts: list[str], a: list[list[int]], b: list[list[int]]) -> None:
        # every byte is a token of A, which therefore never changes a text
        right = [b"".join(map(self.b_bytes.__getitem__, y)) == t.encode() for t, y in zip(texts, b, strict=True)]
        flat = lambda lists: np.fromiter(chain.from_iterable(lists), np.int32)
        sizes = lambda lists: np.fromiter(map(len, lists), np.int64, len(lists))
        self.a_ids, self.b_ids = np.append(self.a_ids, flat(a)), np.append(self.b_ids, flat(b))
        self.a_first = np.append(self.a_first, self.a_first[-1] + np.cumsum(sizes(a)))
        self.b_first = np.append(self.b_first, self.b_first[-1] + np.cumsum(sizes(b)))
        self.right = np.append(self.right, right)

    def _run_b(self, run: str, ids: list[int]) -> list[int]:
        """The tokens of a run: the tokenizer put a space before it, which the run has
        itself or doesn't have at all."""
        if run == " ":
            return [self.space]
        return ids if run[0] == " " else ids[1:] if ids[:1] == [self.space] else []

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What each text (with its space before it) consists of: places of encoded runs,
        and how many of them are its own."""
        if len(self.known) > KEPT_RUNS:
            self.forget()
        runs, counts, whole = [], [], {}
        for i, text in enumerate(texts):
            if self.by_runs and not _RARE.search(text):
                own = _RUN.findall(" " + text)
                runs += own
                counts.append(len(own))
            else:
                whole[i] = len(runs)
                counts.append(1)
        new = list(dict.fromkeys(r for r in runs if r not in self.known))
        if new:
            b = self.b.encode([r[1:] if r[0] == " " else r for r in new], num_threads=1)
            base = len(self.right)
            self._add(new, [self.a.encode_ordinary(r) for r in new], [self._run_b(r, x) for r, x in zip(new, b, strict=True)])
            self.known.update(zip(new, range(base, base + len(new)), strict=True))
        found = np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))
        if whole:
            base = len(self.right)
            odd = [" " + texts[i] for i in whole]
            self._add(odd, [self.a.encode_ordinary(t) for t in odd], self.b.encode([t[1:] for t in odd], num_threads=1))
            found = np.insert(found, list(whole.values()), np.arange(base, base + len(odd)))
        return found, np.array(counts, np.int64)

    def drop_whole(self) -> None:
        """Forget texts that were encoded whole; they are the last ones."""
        n = len(self.known)
        if len(self.right) > n:
            self.right, self.a_first, self.b_first = self.right[:n], self.a_first[: n + 1], self.b_first[: n + 1]
            self.a_ids, self.b_ids = self.a_ids[: self.a_first[-1]], self.b_ids[: self.b_first[-1]]


def _gather(flat: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists at the given places, one after another, and their lengths."""
    sizes = first[at + 1] - first[at]
    ends = np.cumsum(sizes)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[at] - (ends - sizes), sizes)], sizes


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two ascending lists is cut into pieces of ``piece`` entries: how
    many of ``a`` and of ``b`` lie before each cut, by binary search along its diagonal.
    An entry of ``b`` equal to the last of ``a`` before a cut is taken before it too."""
    n, m = len(a), len(b)
    k = np.append(np.arange(0, n + m, piece), n + m)
    low, high = np.maximum(k - m, 0), np.minimum(k, n)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) >> 1
        before = a[middle] <= b[k[open_] - 1 - middle]
        low[open_] = np.where(before, middle + 1, low[open_])
        high[open_] = np.where(before, high[open_], middle)
    i, j = low, k - low
    inside = np.flatnonzero((i > 0) & (j < m))
    j[inside] += a[i[inside] - 1] == b[j[inside]]
    return i, j


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The entries that both lists hold."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return both[1:][both[1:] == both[:-1]]


def common_ends(a: np.ndarray, b: np.ndarray, piece: int) -> np.ndarray:
    i, j = diagonals(a, b, piece)
    return np.concatenate([
        np.zeros(0, np.int64),
        *(_merged(a[i[p] : i[p + 1]], b[j[p] : j[p + 1]]) for p in range(len(i) - 1)),
    ])


def _sizes(ends: np.ndarray, common: np.ndarray) -> np.ndarray:
    """How many tokens each group has."""
    return np.diff(np.searchsorted(ends, common, "right"), prepend=0)


def _links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, doc: np.ndarray):
    """``doc, pair`` and how often, for all links of groups that have ``n_a`` and ``n_b``
    tokens. A wide group counts its different ids, so a text without common ends costs
    what its different pairs cost."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    a_first, b_first = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    wide = n_a * n_b > WIDE
    narrow = np.flatnonzero(~wide)
    left = np.repeat(a_first[narrow], n_a[narrow]) + _within(n_a[narrow])  # A tokens of narrow groups
    group = np.repeat(narrow, n_a[narrow])
    times = n_b[group]
    right = np.repeat(b_first[group], times) + _within(times)
    keys = [(np.repeat(doc[group], times) << (2 * _BITS)) | (np.repeat(a[left], times) << _BITS) | b[right]]
    found, counts = np.unique(keys[0], return_counts=True)
    more, many = [found], [counts.astype(np.int64)]
    for g in np.flatnonzero(wide):
        x, cx = np.unique(a[a_first[g] : a_first[g] + n_a[g]], return_counts=True)
        y, cy = np.unique(b[b_first[g] : b_first[g] + n_b[g]], return_counts=True)
        more.append(((doc[g] << (2 * _BITS)) | (x[:, None] << _BITS) | y).ravel())
        many.append((cx[:, None] * cy).ravel())
    if len(more) > 1:
        found, which = np.unique(np.concatenate(more), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, which, np.concatenate(many))
        return found, total
    return found, many[0]


def _within(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _codes(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The written groups as places in ``Encoders.written``; the groups in ``last`` have no
    sign after them."""
    out = np.empty(len(a) + len(b), np.int64)
    a_end, b_end = np.cumsum(n_a), np.cumsum(n_b)
    sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    sign_a[a_end - 1] = 1
    sign_b[b_end - 1] = np.where(last, 3, 2)
    out[np.arange(len(a)) + np.repeat(b_end - n_b, n_a)] = a * np.int64(4) + sign_a
    out[np.arange(len(b)) + np.repeat(a_end, n_b)] = b * np.int64(4) + sign_b
    return out


def _block_batch(docs: list[dict], keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """A block as one row: its documents, its different pairs with the number of documents
    that hold each, and for each document its entries in this list."""
    mask = (1 << (2 * _BITS)) - 1
    pairs, entry, n_docs = np.unique(keys & mask, return_inverse=True, return_counts=True)
    first = np.searchsorted(keys >> (2 * _BITS), np.arange(len(docs) + 1))
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    kind = pa.struct([(c.split()[0], {"long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in _DOC.split(", ")])
    return pa.RecordBatch.from_arrays([
        one(docs, kind), one(pairs, pa.int64()), one(n_docs.astype(np.int32), pa.int32()),
        one(first.astype(np.int32), pa.int32()), one(entry.astype(np.int32), pa.int32()), one(times, pa.int64()),
    ], ["docs", "pairs", "n_docs", "first", "entry", "times"])


_PIECE_TYPE = pa.struct([
    ("doc", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("a", pa.list_(pa.int32())),
    ("b", pa.list_(pa.int32())), ("a_from", pa.int64()), ("b_from", pa.int64()),
])


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes))


def _aligned_block(e: Encoders, ids: list, texts: list[str]) -> pa.RecordBatch:
    at, runs = e.places(texts)
    doc_runs = _bounds(runs)
    right = np.ones(len(texts), bool)
    right[np.searchsorted(doc_runs, np.flatnonzero(~e.right[at]), "right") - 1] = False
    right &= np.array([bool(t) for t in texts], bool)
    at = at[np.repeat(right, runs)]
    doc_runs = _bounds(np.where(right, runs, 0))
    a, a_runs = _gather(e.a_ids, e.a_first, at)
    b, b_runs = _gather(e.b_ids, e.b_first, at)
    e.drop_whole()
    a_doc, b_doc = _bounds(a_runs)[doc_runs], _bounds(b_runs)[doc_runs]
    n_a, n_b = np.diff(a_doc), np.diff(b_doc)
    long_ = n_a + n_b > PIECE

    pieces = []
    for d in np.flatnonzero(long_):
        own_a, own_b = a[a_doc[d] : a_doc[d + 1]], b[b_doc[d] : b_doc[d + 1]]
        ends_a, ends_b = _bounds(e.a_sizes[own_a]), _bounds(e.b_sizes[own_b])
        i, j = diagonals(ends_a[1:], ends_b[1:], PIECE)
        pieces += [{
            "doc": int(d), "doc_id": ids[d], "piece": p, "a": own_a[i[p] : i[p + 1]], "b": own_b[j[p] : j[p + 1]],
            "a_from": int(ends_a[i[p]]), "b_from": int(ends_b[j[p]]),
        } for p in range(len(i) - 1)]
    short = ~long_
    a, b = a[np.repeat(short, n_a)], b[np.repeat(short, n_b)]
    n_a, n_b = np.where(short, n_a, 0), np.where(short, n_b, 0)
    a_ends, b_ends = np.cumsum(e.a_sizes[a]), np.cumsum(e.b_sizes[b])
    common = common_ends(a_ends, b_ends, PIECE)
    group_a, group_b = _sizes(a_ends, common), _sizes(b_ends, common)
    doc_ends = _bounds(e.a_sizes[a])[_bounds(n_a)]
    groups = np.searchsorted(common, doc_ends, "right")  # groups before the end of each document
    n_groups = np.diff(groups)
    last = np.zeros(len(common), bool)
    last[groups[1:][n_groups > 0] - 1] = True
    codes = _codes(a, b, group_a, group_b, last)
    links = _bounds(group_a * group_b)[groups]
    tokens = _bounds(n_a) + _bounds(n_b)
    docs = []
    for d in np.flatnonzero(short):
        written = b"".join(map(e.written.__getitem__, codes[tokens[d] : tokens[d + 1]].tolist()))
        docs.append({
            "doc_id": ids[d], "n_a": int(n_a[d]), "n_b": int(n_b[d]), "n_groups": int(n_groups[d]),
            "n_links": int(links[d + 1] - links[d]), "groups_sha256": hashlib.sha256(written).hexdigest() if written else "",
        })
    number = np.cumsum(short) - 1
    keys, times = _links(a, b, group_a, group_b, np.repeat(number, n_groups))
    row = _block_batch(docs, keys, times)
    return pa.RecordBatch.from_arrays(
        [*row.columns, pa.array([pieces], pa.list_(_PIECE_TYPE))], [*row.schema.names, "pieces"]
    )


_encoders: dict[int, Encoders] = {}


class Models:
    """The two model files, of some megabytes, read by the driver and broadcast; executors
    need no copy of them."""

    def __init__(self, spark: SparkSession, path_a: str, path_b: str, pattern: str) -> None:
        with open(path_a, "rb") as a, open(path_b, "rb") as b:
            self.files = spark.sparkContext.broadcast((a.read(), b.read(), pattern))

    def encoders(self) -> Encoders:
        """Made once a worker."""
        key = hash(self.files.value)
        if key not in _encoders:
            _encoders[key] = Encoders(*self.files.value)
        return _encoders[key]


def _encode(models: Models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, ids, texts, size = models.encoders(), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text or "")
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield _aligned_block(encoders, ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield _aligned_block(encoders, ids, texts)

    return run


_SIDE = ", ".join(f"{side}_{x} array<int>" for side in ("head", "tail") for x in ("a", "b"))
MERGED_SCHEMA = (
    f"block long, doc int, doc_id long, piece int, cut boolean, n_a long, n_b long, n_groups long, n_links long, {_SIDE}, "
    "written binary, pairs array<long>, times array<long>"
)


def _merge_pieces(models: Models):
    """The groups inside each piece, and its tokens up to the first and after the last
    common end. A piece without a common end is all head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = models.encoders()
        for batch in batches:
            # one piece at a time, as a batch may hold hundreds of them
            for i in range(batch.num_rows):
                r = {k: batch.column(k)[i].as_py() for k in ("block", "doc", "doc_id", "piece", "a_from", "b_from")}
                a, b = (_flat(batch.column(k), i).astype(np.int64) for k in "ab")
                a_ends, b_ends = r.pop("a_from") + np.cumsum(e.a_sizes[a]), r.pop("b_from") + np.cumsum(e.b_sizes[b])
                common = _merged(a_ends, b_ends)
                n_a, n_b = _sizes(a_ends, common), _sizes(b_ends, common)
                low = (n_a[0], n_b[0]) if len(common) else (len(a), len(b))
                high = (int(n_a.sum()), int(n_b.sum())) if len(common) else low
                own = a[low[0] : high[0]], b[low[1] : high[1]], n_a[1:], n_b[1:]
                keys, times = _links(*own, np.zeros(len(n_a[1:]), np.int64))
                codes = _codes(*own, np.zeros(len(n_a[1:]), bool))
                yield pa.RecordBatch.from_pylist([r | {
                    "cut": len(common) > 0, "n_a": len(a), "n_b": len(b),
                    "n_groups": len(n_a[1:]), "n_links": int((n_a[1:] * n_b[1:]).sum()),
                    "head_a": a[: low[0]], "head_b": b[: low[1]], "tail_a": a[high[0] :], "tail_b": b[high[1] :],
                    "written": b"".join(map(e.written.__getitem__, codes.tolist())), "pairs": keys, "times": times,
                }], schema=_merged_type())

    return run


def _flat(lists: pa.Array, i: int) -> np.ndarray:
    """The numbers of a list, without a Python number for each."""
    return lists[i].values.to_numpy()


def _merged_type() -> pa.Schema:
    ids, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    return pa.schema([
        ("block", pa.int64()), ("doc", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("cut", pa.bool_()),
        ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
        ("head_a", ids), ("head_b", ids), ("tail_a", ids), ("tail_b", ids),
        ("written", pa.binary()), ("pairs", longs), ("times", longs),
    ])


def _stitch(models: Models):
    """One document from its pieces: open sides that meet become a group, what is written
    is hashed in order."""

    def run(table: pa.Table) -> pa.Table:
        e = models.encoders()
        rows = table.combine_chunks().to_batches()[0]
        digest, held_a, held_b, keys, times = hashlib.sha256(), [], [], [], []
        doc = {"doc_id": rows.column("doc_id")[0].as_py(), "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0}
        first = True
        for i in np.argsort(rows.column("piece").to_numpy(), kind="stable").tolist():
            for name in ("n_a", "n_b", "n_groups", "n_links"):
                doc[name] += rows.column(name)[i].as_py()
            held_a.append(_flat(rows.column("head_a"), i))
            held_b.append(_flat(rows.column("head_b"), i))
            if not rows.column("cut")[i].as_py():
                continue
            a, b = np.concatenate(held_a).astype(np.int64), np.concatenate(held_b).astype(np.int64)
            n_a, n_b, one = np.array([len(a)]), np.array([len(b)]), np.zeros(1, np.int64)
            written = b"".join(map(e.written.__getitem__, _codes(a, b, n_a, n_b, np.ones(1, bool)).tolist()))
            digest.update(written if first else b";" + written)
            first = False
            if inside := rows.column("written")[i].as_py():
                digest.update(b";" + inside[:-1])
            found, many = _links(a, b, n_a, n_b, one)
            keys += [found, _flat(rows.column("pairs"), i)]
            times += [many, _flat(rows.column("times"), i)]
            doc["n_groups"] += 1
            doc["n_links"] += len(a) * len(b)
            held_a, held_b = [_flat(rows.column("tail_a"), i)], [_flat(rows.column("tail_b"), i)]
        found, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, which, np.concatenate(times))
        return pa.Table.from_batches([_block_batch([doc | {"groups_sha256": digest.hexdigest()}], found, total)])

    return run


def _count_links(block: pa.Table, answer: pa.Table) -> pa.Table:
    """The rows of the documents of a block, from the counts of its pairs."""
    row = block.combine_chunks().to_batches()[0]
    docs = row.column("docs")[0].values.flatten()
    first, entry, times = (_flat(row.column(c), 0) for c in ("first", "entry", "times"))
    at = answer.column("at").to_numpy()
    sums = []
    for name in ("best", "count"):
        weight = np.zeros(len(at), np.int64)
        weight[at] = answer.column(name).to_numpy()
        sums.append(np.diff(_bounds(times * weight[entry])[first]) if len(entry) else np.zeros(len(docs[0]), np.int64))
    names = [c.split()[0] for c in _DOC.split(", ")]
    return pa.Table.from_arrays([*docs, pa.array(sums[0]), pa.array(sums[1])], [*names, "n_best", "count_sum"])


def aligned_blocks(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents with their groups written and their links counted, stored."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = f"struct<{', '.join(': '.join(c.split(' ', 1)) for c in PIECE_SCHEMA.split(', '))}>"
    encoded = texts.mapInArrow(_encode(models), f"{BLOCK_SCHEMA}, pieces array<{kind}>")
    stored = materialize(encoded.withColumn("block", F.monotonically_increasing_id()), **WIDE_ROWS)
    pieces = stored.where("size(pieces) > 0").select("block", F.inline("pieces"))
    merged = pieces.repartition("block", "doc", "piece").mapInArrow(_merge_pieces(models), MERGED_SCHEMA)
    stitched = merged.groupBy("block", "doc").applyInArrow(_stitch(models), BLOCK_SCHEMA)
    # blocks of single long documents have numbers below zero
    long_ = materialize(stitched.withColumn("block", -1 - F.monotonically_increasing_id()), **WIDE_ROWS)
    return stored.drop("pieces").unionByName(long_)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, count, best``: in how many documents two tokens are linked, and whether no
    other B token is linked with the A token in more."""
    counted = blocks.select(F.inline(F.arrays_zip("pairs", "n_docs"))).groupBy("pairs").agg(
        F.sum("n_docs").alias("count")
    )
    counts = materialize(counted.select(F.col("pairs").alias("pair"), "count", F.shiftright("pairs", _BITS).alias("a")))
    # one row for each token of A, so never more than its vocabulary has
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), "a").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best")
    )


def align(
    docs: DataFrame, path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B, pattern: str = PATTERN,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b`` (tokens), ``n_groups, n_links,
    groups_sha256`` (of the groups as ``a1,a2|b1;a3|b2``), ``n_best`` (links whose pair has
    the highest count of its A token) and ``count_sum`` (the counts of all links).

    ``path_a`` is a byte-level vocabulary with its ``pattern``, ``path_b`` a piece model.
    Both encode the text with a space before it, special tokens as plain text. Null and
    empty texts, and those that either tokenizer changes, have no tokens: all figures are
    zero and the digest is ''. Each row is a document of its own, also where ids repeat or
    are null. Other columns are not read. An empty table gives an empty one. A text is
    encoded, and its digest made, in one task; pieces of long ones are merged in many.
    """
    models = Models(docs.sparkSession, path_a, path_b, pattern)
    blocks = aligned_blocks(docs, models, id_col, text_col)
    own = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    # rows, not a list for each block: what a task holds of them can go to disk
    answers = own.join(materialize(pair_counts(blocks)), "pair").select(
        F.col("block").alias("of_block"), "at", "count", "best"
    )
    bare = blocks.select("block", "docs", "first", "entry", "times")
    return bare.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(
        _count_links, f"{_DOC}, n_best long, count_sum long"
    )
