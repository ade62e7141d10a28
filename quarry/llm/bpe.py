"""Byte-pair encoding and decoding of whole documents, by tree concatenation.

A vocabulary file of the tokenizers library is applied exactly. A text of more than ``leaf``
bytes is halved, and halved again, wherever that falls, into leaves that are encoded in
parallel, on any executors. Neighbours are then joined pairwise, as in a tree: a growing window
around each join is encoded anew until it fits both sides. Where white space is near, the
window has grown enough when a whole word lies on either side of the join: white space
separates pre-tokens in these vocabularies, so what stands beyond is encoded alike. In a run
without white space that is longer than a leaf, the window grows by tokens: a BPE encoding is
exact if and only if each adjacent pair of its tokens is one (encoding the pair's symbols gives
back the pair), so agreement at both ends is exactness.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import as_bytes, cut, importable, small_batches

#: Bytes (in a run without white space: symbols) of a leaf of the tree. Texts of up to this length are encoded whole.
LEAF = 8192
#: Bytes at a join that are looked at first.
EDGE = 64
#: Entries of a worker's memories of words and pre-tokens; they are emptied when full.
WORDS, PRETOKENS = 100_000, 600_000

#: Texts of printable ASCII and Latin-1 letters, for which lower-casing and splitting are plain.
_SIMPLE = re.compile(rb"[\x09-\x0d\x20-\x7e]*(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][\x09-\x0d\x20-\x7e]*)*")
_SPLIT = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z\xdf-\xf6\xf8-\xff0-9]+")
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character, as byte-level vocabularies write them."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """Merging of symbol ids by rank, for text that has no boundary of its own."""

    def __init__(self, model: dict) -> None:
        vocab = model["vocab"]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            made = vocab[left + right]
            self.pairs[vocab[left], vocab[right]] = (rank, made)
            self.parts.setdefault(made, (vocab[left], vocab[right]))
        self._fits: dict[tuple[int, int], bool] = {}

    def encode(self, symbols: list[int]) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left: O(n log n)."""
        n = len(symbols)
        ids, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.pairs[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.pairs]
        heap = [(rank, i, made, ids[i], ids[i + 1]) for rank, made, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (hit := self.pairs.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (hit[0], a, hit[1], ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    def symbols(self, ids: list[int]) -> list[int]:
        out, todo = [], list(reversed(ids))
        while todo:
            x = todo.pop()
            if x in self.parts:
                left, right = self.parts[x]
                todo += [right, left]
            else:
                out.append(x)
        return out

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side are an encoding."""
        if (left, right) not in self._fits:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            self._fits[left, right] = self.encode(self.symbols([left, right])) == [left, right]
        return self._fits[left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring texts, from their own encodings."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = self.encode(self.symbols(left[a:] + right[:b]))
            if (a == 0 or self.fits(left[a - 1], window[0])) and (b == len(right) or self.fits(window[-1], right[b])):
                return left[:a] + window + right[b:]
            width *= 2

    def tree(self, leaves: list[list[int]]) -> list[int]:
        """Join encoded leaves pairwise, level by level."""
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []


class Encoder:
    """One vocabulary in one worker process, with bounded memories of what it has encoded."""

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.leaf, self.spec = leaf, spec
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.token_bytes = [x.encode() for x in self.tokens]
        self.letters = byte_alphabet()
        model = spec["model"]
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.added = [x["content"].encode() for x in spec["added_tokens"]]
        self.specials = re.compile(b"|".join(map(re.escape, self.added))) if self.added else None
        steps = spec.get("normalizer") or {}
        pre = spec.get("pre_tokenizer") or {}
        #: Whether words split as _SPLIT splits them once they are lower-case.
        self.plain = (
            [x["type"] for x in steps.get("normalizers", ())] == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in pre.get("pretokenizers", ())] == ["Split", "ByteLevel"]
            and pre["pretokenizers"][0]["pattern"].get("Regex") == _WORD_SPLIT
            and not pre["pretokenizers"][1]["add_prefix_space"] and not pre["pretokenizers"][1]["use_regex"]
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and not spec.get("post_processor")
        )
        if not self.plain:
            raise ValueError(f"{path}: this operator takes vocabularies whose pre-tokens end at white space")
        self._merges: Merges | None = None
        self.words: dict[bytes, bytes] = {}
        self.pretokens: dict[str, bytes] = {}

    @property
    def merges(self) -> Merges:
        if self._merges is None:
            self._merges = Merges(self.spec["model"])
        return self._merges

    def _pretoken(self, text: str) -> bytes:
        mapped = text.encode().decode("latin-1").translate(self.letters)
        if len(mapped) <= self.leaf:
            return np.array([x.id for x in self.tokenizer.model.tokenize(mapped)], "<u4").tobytes()
        return np.array(self.gather([(self.merges.encode(s), on) for s, on in self._leaves(mapped)]), "<u4").tobytes()

    def _simple(self, text: bytes) -> bytes:
        """Ids of a text that _SIMPLE matches and that holds no added token."""
        parts = _SPLIT.findall(text.decode().lower())
        cache = self.pretokens
        try:
            return b"".join(map(cache.__getitem__, parts))
        except KeyError:
            fresh = {p: self._pretoken(p) for p in set(parts) if p not in cache}
        if len(cache) + len(fresh) > PRETOKENS:
            cache.clear()
        elif all(len(p) <= 64 for p in fresh):
            cache.update(fresh)
            return b"".join(map(cache.__getitem__, parts))
        cache.update({p: x for p, x in fresh.items() if len(p) <= 64})
        return b"".join([x if (x := cache.get(p)) is not None else x if (x := fresh.get(p)) is not None else self._pretoken(p) for p in parts])

    def word(self, word: bytes) -> bytes:
        """Ids of one run without ASCII white space, little-endian unsigned 32-bit."""
        got = self.words.get(word)
        if got is None:
            if len(word) > self.leaf:
                return np.array(self.gather([(self.merges.encode(s), on) for s, on in self.pieces(word)]), "<u4").tobytes()
            if _SIMPLE.fullmatch(word) and not (self.specials and self.specials.search(word)):
                got = self._simple(word)
            else:
                got = np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
            if len(word) <= 64:
                if len(self.words) >= WORDS:
                    self.words.clear()
                self.words[word] = got
        return got

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a whole text."""
        if not text:
            return b""
        if _SIMPLE.fullmatch(text) and not (self.specials and self.specials.search(text)):
            return self._simple(text)
        return b"".join(map(self.word, text.split()))

    def decode(self, ids: bytes) -> bytes:
        """What the library's decode gives: without a decoder, the tokens joined by spaces."""
        return b" ".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    # Runs without a boundary

    def pieces(self, word: bytes) -> list[tuple[list[int], int]]:
        """A word's pre-tokens as symbol ids, longer ones cut: (symbols, whether it goes on)."""
        text, parts = word.decode("utf-8", "replace"), []
        for chunk in re.split("(" + "|".join(re.escape(x.decode()) for x in self.added) + ")", text) if self.added else [text]:
            if not chunk:
                continue
            if chunk.encode() in self.added:
                parts.append(([self.tokenizer.token_to_id(chunk)], 0))
                continue
            normal = self.tokenizer.normalizer.normalize_str(chunk)
            for mapped, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                parts += self._leaves(mapped)
        return parts

    def _leaves(self, mapped: str) -> list[tuple[list[int], int]]:
        symbols = [self.vocab[c] for c in mapped[:-1]] + [self.vocab[mapped[-1] + self.suffix]]
        return [(symbols[i : i + self.leaf], int(i + self.leaf < len(symbols))) for i in range(0, len(symbols), self.leaf)]

    def gather(self, leaves: list[tuple[list[int], int]]) -> list[int]:
        """Encoded leaves of a word -> its ids; leaves that go on are joined as a tree."""
        out, run = [], []
        for ids, on in leaves:
            run.append(ids)
            if not on:
                out += self.merges.tree(run)
                run = []
        return out + (self.merges.tree(run) if run else [])


_HEAD, _TAIL = re.compile(rb"\S*\s+\S+(?=\s)"), re.compile(rb"\s(\S+\s+\S*)\Z")


def halves(text: bytes, leaf: int) -> list[bytes]:
    """A UTF-8 text, halved until no part has more than about leaf bytes; characters stay whole."""
    if len(text) <= leaf:
        return [text]
    middle = len(text) // 2
    while middle < len(text) and text[middle] & 0xC0 == 0x80:
        middle += 1
    return [text] if middle == len(text) else halves(text[:middle], leaf) + halves(text[middle:], leaf)


def edges(text: bytes) -> tuple[bytes, bytes]:
    """What joins look at: a text's first bytes, and its last, up to a whole word beside the one that may be cut; else all of it."""
    head = tail = text
    width = EDGE
    while width < len(text) and not (m := _HEAD.match(text[:width])):
        width *= 2
    if width < len(text):
        head = text[: m.end()]
    width = EDGE
    while width < len(text) and not (m := _TAIL.search(text[-width:])):
        width *= 2
    if width < len(text):
        tail = m.group(1)
    return head, tail


@dataclass
class Half:
    """An encoded part of a text: its ids, its first and its last bytes, and whether those are all of it."""

    ids: bytes
    head: bytes
    tail: bytes
    head_all: bool
    tail_all: bool

    def join(self, other: Half, encode: Callable[[bytes], bytes]) -> Half:
        """Both, one after the other: the window around the join is encoded anew, and must fit what both sides have there."""
        left, right = encode(self.tail), encode(other.head)
        if not self.ids.endswith(left) or not other.ids.startswith(right):
            raise ValueError("the halves of a text don't agree with the window around their join")
        ids = self.ids[: len(self.ids) - len(left)] + encode(self.tail + other.head) + other.ids[len(right) :]
        head = self.head + other.head if self.head_all else self.head
        tail = self.tail + other.tail if other.tail_all else other.tail
        return Half(ids, head, tail, self.head_all and other.head_all, self.tail_all and other.tail_all)


def joined(parts: list[Half], encode: Callable[[bytes], bytes]) -> bytes:
    """The ids of a text from its halves, joined level by level."""
    while len(parts) > 1:
        parts = [parts[i].join(parts[i + 1], encode) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0].ids if parts else b""


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, leaf: int = LEAF) -> Encoder:
    """This process's encoder of a vocabulary file, which every executor has."""
    if (path, leaf) not in _ENCODERS:
        _ENCODERS[path, leaf] = Encoder(path, leaf)
    return _ENCODERS[path, leaf]


def _strings(x: list[str]) -> pa.Array:
    return pa.array(x, pa.string())


def _digests(e: Encoder, all_ids: list[bytes]) -> list[pa.Array]:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return [
        pa.array([len(x) // 4 for x in all_ids], pa.int64()),
        _strings([sha(x) for x in all_ids]),
        _strings([sha(e.decode(x)) for x in all_ids]),
    ]


NAMES = ["n_tokens", "ids_sha256", "decoded_sha256"]
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def has_long_run(text, leaf: int = LEAF):
    """Native test for a run without ASCII white space of more than leaf characters."""
    return F.coalesce((F.length(text) > leaf) & text.rlike(rf"[^\x20\x09-\x0D]{{{leaf + 1}}}"), F.lit(False))


def token_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids): each row's ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Repeated rows and ids give repeated results. Other
    columns are not looked at.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, leaf)
        for b in batches:
            texts = as_bytes(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.encode(x) for x in texts], pa.binary())], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {id_type}, ids binary")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text.

    Texts of at most ``leaf`` bytes are encoded where they are read. The others are cut into
    leaves, which are written, encoded wherever they are read, and joined. Null and empty texts
    have no tokens and the digests of nothing. Rows stay as many as they are, repeated ids
    included; a null id stays null. Other columns are not looked at.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    long = F.coalesce(F.octet_length("text") > leaf, F.lit(False))

    def short_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, leaf)
        for b in batches:
            texts = as_bytes(b.column(1))
            for i in range(0, len(texts), 256):
                ids = [e.encode(x) for x in texts[i : i + 256]]
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 256], *_digests(e, ids)], ["doc_id", *NAMES])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, leaf)
        for b in batches:
            for row_id, row, long_run, text in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), as_bytes(b.column(3))):
                parts = [(np.array(x, "<u4").tobytes(), on) for x, on in plain_and_cut(e, text)] if long_run else [(x, 3) for x in halves(text, leaf)]
                for i in range(0, len(parts), 64):
                    some = parts[i : i + 64]
                    columns = [
                        pa.array([row_id.as_py()] * len(some), b.column(0).type), pa.array([row] * len(some), pa.int64()), pa.array(range(i, i + len(some)), pa.int32()),
                        pa.array([x[1] for x in some], pa.int32()), pa.array([x[0] for x in some], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "part", "on", "piece"])

    def plain_and_cut(e: Encoder, text: bytes) -> list[tuple[list[int], int]]:
        """Parts in order: (ids, 2) of words between long ones, and the leaves of long ones."""
        parts, plain = [], []
        for w in text.split():
            if len(w) <= leaf:
                plain.append(w)
                continue
            parts += [(np.frombuffer(e.encode(b" ".join(plain)), "<u4").tolist(), 2)] * bool(plain) + e.pieces(w)
            plain = []
        return parts + [(np.frombuffer(e.encode(b" ".join(plain)), "<u4").tolist(), 2)] * bool(plain)

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, leaf)
        for b in batches:
            done, heads, tails = [], [], []
            for x, on in zip(b.column(4).to_pylist(), b.column(3).to_pylist()):
                head, tail = edges(x) if on == 3 else (None, None)
                done.append(e.encode(x) if on == 3 else x if on == 2 else np.array(e.merges.encode(np.frombuffer(x, "<u4").tolist()), "<u4").tobytes())
                heads.append(head), tails.append(tail)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(x, pa.binary()) for x in (done, heads, tails)), pa.array([len(x) for x in b.column(4).to_pylist()], pa.int32())], encoded)

    def join_up(got: pa.Table) -> pa.Table:
        e = encoder(path, leaf)
        got = got.sort_by("part")
        if got["on"][0].as_py() == 3:
            parts = [Half(ids, head, tail, len(head) == n, len(tail) == n) for ids, head, tail, n in zip(*(got[c].to_pylist() for c in encoded[4:]))]
            ids = joined(parts, e.encode)
        else:
            ids = np.array(e.gather([(np.frombuffer(x, "<u4").tolist(), on if on == 1 else 0) for x, on in zip(got["ids"].to_pylist(), got["on"].to_pylist())]), "<u4").tobytes()
        return pa.table([got["doc_id"].slice(0, 1), *_digests(e, [ids])], names=["doc_id", *NAMES])

    encoded = ["doc_id", "row", "part", "on", "ids", "head", "tail", "n"]
    schema = f"doc_id {id_type}, {SCHEMA}"
    short = rows.filter(~long).mapInArrow(short_run, schema)
    with small_batches(docs.sparkSession, 256):
        pieces = rows.filter(long).select("doc_id", F.monotonically_increasing_id().alias("row"), has_long_run(F.col("text"), leaf), "text")
        leaves = cut(pieces.mapInArrow(cut_up, f"doc_id {id_type}, row long, part int, on int, piece binary"), "leaves")
    done = leaves.mapInArrow(encode_leaves, f"doc_id {id_type}, row long, part int, on int, ids binary, head binary, tail binary, n int")
    return short.unionByName(done.groupBy("row").applyInArrow(join_up, schema))
