"""BPE encoding and decoding, with tree concatenation for long text that no rule splits.

A text is cut where the tokenizer's own pre-tokenizer must cut, each distinct piece is encoded
once by the tokenizers library and remembered in a bounded table, and the ids are joined. A piece
that no rule splits (a long run of letters, digits, symbols or spaces) is halved until its leaves
are short; leaves are rows of a DataFrame of their own, so executors encode them in parallel, and
neighbours are joined pairwise up the tree. At each join a window of tokens on both sides is
encoded again and grows until its first and last token are the ones that stood there before:
BPE output is determined by its adjacent pairs, so from there on both sides agree exactly.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberlog.llm.common import give_back, text_or_empty

#: Code points of an unsplit run from which it is encoded as a tree, and bytes of a leaf.
LONG_RUN, LEAF = 4096, 2048
#: Pieces remembered by a Python worker, and the longest piece worth remembering.
REMEMBERED, LONGEST_PIECE = 400_000, 64

#: The rule by which byte-level vocabularies of this kind split text.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Normaliser and rule of the vocabulary with word ends, whose pieces may go to the quicker library.
WORD_RULE = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = b"\xff"


def _latin_parts(end: int) -> re.Pattern:
    """WORD_PATTERN for texts below a code point, with classes spelled out from the character database."""
    kind = {c: unicodedata.category(chr(c))[0] for c in range(end)}
    chosen = lambda k: "".join(f"\\u{c:04x}" for c in range(end) if kind[c] == k)
    letters, numbers = chosen("L"), chosen("N")
    return re.compile(WORD_PATTERN.split("|[")[0] + f"|[{letters}]+|[{numbers}]|[^\\t-\\r \\x85\\xa0{letters}{numbers}]+")


_LATIN_END = "\u0130"
_LATIN_PARTS = _latin_parts(ord(_LATIN_END))
_GAP = re.compile(r" (?=\S)")
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PLAIN_SPACE = re.compile("[\t-\r ]+")
_SPACE_THEN = ("  ", " \n", " \t", " \r", " \x0b", " \x0c")


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _Table(dict):
    """Packed ids by piece, made when first asked for; emptied when full, and long pieces are not kept."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size = make, size

    def make_room(self, more: int) -> None:
        if len(self) + more > self.size:
            self.clear()

    def __missing__(self, piece: str):
        ids = self.make(piece)
        if len(piece) <= LONGEST_PIECE:
            self.make_room(1)
            self[piece] = ids
        return ids


class PieceEncoder:
    """Encodes whole texts as the tokenizers library does, each distinct piece once."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.remembered = remembered
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        if plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            self.kind = "byte"
        elif plain and pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed" and pre["pretokenizers"][0].get("invert"):
            self.kind = "word"  # what the pattern does not match is dropped, and it matches no white space
        else:
            self.kind = "whole"
        self.special = {t["content"]: t["id"] for t in added}
        self._special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        quick = self.kind == "byte" or self.kind == "word" and WORD_RULE == spec["normalizer"] and WORD_PATTERN == pre["pretokenizers"][0]["pattern"]["Regex"]
        self._fast = self._ranked(spec) if quick else None
        self._spaced = _Table(lambda piece: self._piece(" " + piece), remembered)
        self._bare = _Table(self._piece, remembered)
        self._bytes: list[bytes] | None = None

    def _ranked(self, spec: dict):
        """The same byte-level vocabulary for a quicker library: possible where ids stand in the order of the merges.

        A mark for the end of a word becomes a byte that no UTF-8 text holds.
        """
        import tiktoken

        model, back = spec["model"], {c: bytes([b]) for b, c in byte_alphabet().items()}
        vocab, suffix, special = model["vocab"], model.get("end_of_word_suffix") or "", {t["content"] for t in spec["added_tokens"]}
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges")):
            return None
        base = [c + end for end in {"", suffix} for c in back]
        made = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
        if not set(base) <= vocab.keys() or any(x >= y for x, y in zip([max(vocab[c] for c in base), *made], made, strict=False)):
            return None

        def raw(token: str) -> bytes | None:
            end = suffix and token.endswith(suffix)
            parts = [back.get(c) for c in (token[: -len(suffix)] if end else token)]
            return None if None in parts else b"".join(parts) + (WORD_END if end else b"")

        ranks = {r: k for token, k in vocab.items() if token not in special and (r := raw(token)) is not None}
        if suffix:
            ranks.setdefault(WORD_END, len(vocab) + len(special))
        return tiktoken.Encoding("ranked", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    # --- encoding ---

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if self.kind == "whole":
            return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        if self.kind == "word":
            return [self._ids(self._bare, self._words(t)) for t in texts]
        out = []
        for text in texts:
            if self._special_at and "<" in text and self._special_at.search(text):
                parts = self._special_at.split(text)
                ids = [np.array([self.special[p]], np.uint32) if k % 2 else self._byte_text(p) for k, p in enumerate(parts)]
                out.append(np.concatenate(ids))
            else:
                out.append(self._byte_text(text))
        return out

    def _byte_text(self, text: str) -> np.ndarray:
        """A space before a visible character always begins a new pre-token, so text may be cut there."""
        if not text:
            return np.zeros(0, np.uint32)
        if any(s in text for s in _SPACE_THEN) or _ODD_SPACE.search(text):
            pieces = _GAP.split(text)
        else:
            pieces = text.split(" ")
        ids = self._ids(self._spaced, pieces[1:])
        return np.concatenate([np.frombuffer(self._bare[pieces[0]], "<u4"), ids]) if pieces[0] else ids

    @staticmethod
    def _ids(table: _Table, pieces: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(table.__getitem__, pieces)), "<u4")

    def _words(self, text: str) -> list[str]:
        return list(filter(None, _PLAIN_SPACE.split(text))) if _ODD_SPACE.search(text) else text.split()

    def _piece(self, piece: str) -> bytes:
        if self.kind == "byte" and len(piece) >= LONG_RUN:
            return np.concatenate([self.run(run) for run, _ in self.tok.pre_tokenizer.pre_tokenize_str(piece)]).astype("<u4").tobytes()
        if self._fast is not None and self.kind == "byte":
            return _packed(self._fast.encode_ordinary(piece))
        if self._fast is not None and max(piece) < _LATIN_END and "<|" not in piece:
            one, parts = self._fast._encode_single_piece, _LATIN_PARTS.findall(unicodedata.normalize("NFC", piece).lower())
            return _packed([k for p in parts for k in one(p.encode() + WORD_END)])
        return _packed(self.tok.encode(piece, add_special_tokens=False).ids)

    # --- tree concatenation; runs are in the tokenizer's byte alphabet, one letter a byte ---

    def leaf(self, run: str) -> list[int]:
        return [t.id for t in self.tok.model.tokenize(run)]

    def run(self, run: str) -> np.ndarray:
        """One unsplit run in this process: the same leaves and joins as across executors."""
        if len(run) <= LEAF:
            return np.array(self.leaf(run), np.uint32)
        leaves = [self.leaf(run[a:b]) for a, b in halves(len(run))]
        return np.array(self.concatenate(leaves), np.uint32)

    def concatenate(self, leaves: list[list[int]]) -> list[int]:
        while len(leaves) > 1:
            leaves = [self.join(*leaves[k : k + 2]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encodes a growing window around the join until it begins and ends with the tokens that were there."""
        if not left or not right:
            return left + right
        token, width = self.tok.id_to_token, 4
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            ids = self.leaf("".join(map(token, left[a:])) + "".join(map(token, right[:b])))
            starts = a == 0 or (ids[0] == left[a])
            ends = b == len(right) or (ids[-1] == right[b - 1])
            if starts and ends:
                return left[:a] + ids + right[b:]
            width *= 2

    # --- decoding ---

    def decode(self, ids) -> str:
        """As the library's decode with skip_special_tokens=False, for byte-level vocabularies."""
        if self.kind != "byte":
            return self.tok.decode(list(ids), skip_special_tokens=False)
        if self._bytes is None:
            back = {c: b for b, c in byte_alphabet().items()}
            size = self.tok.get_vocab_size(with_added_tokens=True)
            names = [self.tok.id_to_token(k) or "" for k in range(size)]
            self._bytes = [n.encode() if n in self.special or any(c not in back for c in n) else bytes(back[c] for c in n) for n in names]
        return b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace")


def byte_alphabet() -> dict[int, str]:
    """The printable letter for each byte in byte-level vocabularies: printable Latin-1 stays, others follow from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


def halves(n: int, leaf: int = LEAF) -> list[tuple[int, int]]:
    """[0, n) halved 2^d times, until no part is longer than leaf, so that neighbours join pairwise."""
    parts = 1
    while n > parts * leaf:
        parts *= 2
    cuts = [n * k // parts for k in range(parts + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def ids_to_bytes(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def text_batches(batches, chars: int = 1 << 20):
    """Arrow batches cut so that the texts of each hold about so many bytes, and at least a row.

    At the end of a task the worker gives freed memory back, as workers live on from stage to stage.
    """
    yield from _cut(batches, chars)
    give_back()


def _cut(batches, chars: int):
    for batch in batches:
        at = batch.schema.get_field_index("text")
        size, start, held = batch.column(at).nbytes, 0, 0
        if size <= chars:
            yield batch
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        for k, n in enumerate(lengths):
            held += int(n)
            if held >= chars:
                yield batch.slice(start, k + 1 - start)
                start, held = k + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def encode(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(row_key, key, ids): every whole text as ids, little-endian unsigned 32-bit in `ids`.

    Nulls count as empty texts and give no ids; repeated rows stay repeated rows; other columns
    than key and text are not looked at. An empty table gives an empty table.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(key), text_or_empty().alias("text"))
    gap = "[ \\t-\\r]"
    long = F.col("text").rlike(f"(?<![^ \\t-\\r])[^ \\t-\\r]{{{LONG_RUN},}}|(?<!{gap}){gap}{{{LONG_RUN},}}")
    out = f"row_key long, {key} {dict(docs.dtypes)[key]}, ids binary"

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in text_batches(batches):
            ids = [x.tobytes() for x in enc.encode_all(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["row_key", key, "ids"])

    short = rows.where(~long).mapInArrow(plain, out)
    return short.unionByName(_encode_long(rows.where(long), path, key, out))


def _encode_long(rows: DataFrame, path: str, key: str, out: str) -> DataFrame:
    """Texts with long unsplit runs: leaves over all executors, then a tree of joins for each text."""
    kind = dict(rows.dtypes)[key]
    leaves = f"row_key long, {key} {kind}, unit int, leaf int, run boolean, piece string"

    def cut(batches):
        enc = encoder(path)
        for batch in text_batches(batches):
            for row_key, k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, unit = [], 0
                for is_run, piece in units(enc, text):
                    for leaf, (a, b) in enumerate(halves(len(piece)) if is_run else [(0, len(piece))]):
                        rows.append((row_key, k, unit, leaf, is_run, piece[a:b]))
                    unit += 1
                cols = list(zip(*(rows or [(row_key, k, 0, 0, False, "")]), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], batch.column(1).type), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.bool_()), pa.array(cols[5], pa.string())],
                    ["row_key", key, "unit", "leaf", "run", "piece"],
                )

    def encode_leaves(batches):
        enc = encoder(path)
        for batch in batches:
            ids = [ids_to_bytes(enc.leaf(p) if r else enc.encode(p)) for r, p in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(ids, pa.binary())], ["row_key", key, "unit", "leaf", "run", "ids"])

    def join_text(table: pa.Table) -> pa.Table:
        enc = encoder(path)
        table = table.sort_by([("unit", "ascending"), ("leaf", "ascending")])
        units, runs, parts = (table.column(c).to_pylist() for c in ("unit", "run", "ids"))
        found, k = [], 0
        while k < len(units):
            end = k
            while end < len(units) and units[end] == units[k]:
                end += 1
            own = [np.frombuffer(p, "<u4") for p in parts[k:end]]
            found.append(np.array(enc.concatenate([x.tolist() for x in own]), "<u4") if runs[k] and len(own) > 1 else own[0])
            k = end
        return pa.table({"row_key": table.column("row_key")[:1], key: table.column(key)[:1], "ids": pa.array([np.concatenate(found).tobytes()], pa.binary())})

    spread = rows.mapInArrow(cut, leaves).repartition("row_key", "unit", "leaf")
    encoded = spread.mapInArrow(encode_leaves, leaves.replace("piece string", "ids binary"))
    return encoded.groupBy("row_key").applyInArrow(join_text, out)


def units(enc: PieceEncoder, text: str) -> Iterator[tuple[bool, str]]:
    """A text as (is a long unsplit run, piece): runs are in the byte alphabet, the rest is text cut at safe places."""
    if enc.kind != "byte":
        yield False, text
        return
    parts = enc._special_at.split(text) if enc._special_at else [text]
    for k, part in enumerate(parts):
        if k % 2:
            yield False, part
            continue
        held: list[str] = []
        size = 0
        for n, piece in enumerate(_GAP.split(part)):
            piece = piece if n == 0 else " " + piece
            if len(piece) < LONG_RUN:
                held.append(piece)
                size += len(piece)
                if size >= 1 << 16:
                    yield False, "".join(held)
                    held, size = [], 0
                continue
            if held:
                yield False, "".join(held)
                held, size = [], 0
            start = 0
            for run, (a, b) in enc.tok.pre_tokenizer.pre_tokenize_str(piece):
                if len(run) > LEAF:
                    if a > start:
                        yield from _runs(enc, piece[start:a])
                    yield True, run
                    start = b
            if start < len(piece):
                yield from _runs(enc, piece[start:])
        if held:
            yield False, "".join(held)


def _runs(enc: PieceEncoder, text: str) -> Iterator[tuple[bool, str]]:
    """Short pre-tokens beside a long one: each is a run of its own, so no rule sees across the cut."""
    for run, _ in enc.tok.pre_tokenizer.pre_tokenize_str(text):
        yield True, run


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text) for the ids that encode() made."""
    kind = dict(encoded.dtypes)[key]

    def texts(batches):
        enc = encoder(path)
        for batch in batches:
            found = [enc.decode(np.frombuffer(b, "<u4").tolist()) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(texts, f"{key} {kind}, text string")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """What a round trip gives: number of ids, digest of the ids, digest of the decoded text."""
    import hashlib

    def sums(batches):
        enc, decimal = encoder(path), {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                n, a, b = [], [], []
                for raw in part.column(1).to_pylist():
                    ids = np.frombuffer(raw, "<u4").tolist()
                    if not decimal:
                        decimal = {k: str(k) for k in range(enc.tok.get_vocab_size(with_added_tokens=True))}
                    n.append(len(ids))
                    a.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(sums, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
