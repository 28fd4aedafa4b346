"""Exact encoding and decoding with a SentencePiece merge model (operator 2).

The encoder never builds a merge queue over a text. It cuts a text at places
that no piece spans, and tokenises each chunk by backtracking over the
Aho-Corasick matches that start at each position, longest first: a match may
follow the token before it only if merging the two tokens' characters again
gives back just these two tokens, and a bitfield holds the positions from
which no continuation exists. Chunks and token pairs are memoised per task in
bounded tables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxara.llm.common import lean, own_columns

META = "▁"
#: Chunks held per Python worker in each of two generations, a full one replacing the older; and pairs. Workers stay
#: while other stages run, so both are small.
CACHE, PAIRS = 80_000, 250_000
LONG_CHUNK = 64
#: Characters of ids and decoded text in a batch that leaves a task, about.
HELD_CHARS = 1 << 20


class PieceModel:
    """The vocabulary of a merge-type model: pieces, scores and byte pieces.

    Only models whose normaliser is the identity with a dummy prefix are taken;
    the constructor checks that.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.unknown = model.unk_id()
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i)}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = special
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special and i not in self.byte_of and not model.is_unused(i)}
        probe = " a ﬁ  é "
        if model.normalize(probe) != META + probe.replace(" ", META):
            raise ValueError("the model's normaliser changes texts; only identity with a dummy prefix is supported")
        self.plain = [None if i in special or i in self.byte_of else p.replace(META, " ") for i, p in enumerate(self.pieces)]
        # Runs of the space mark share one score, the lowest; they merge last and from the left.
        self.runs = {len(p): i for p, i in self.ids.items() if len(p) > 1 and not p.strip(META)}
        self.rank = {p: -model.get_score(i) for p, i in self.ids.items() if len(p) > 1 and i not in self.runs.values()}
        if len(set(self.rank.values())) != len(self.rank) or any(META in p[1:] for p in self.rank):
            raise ValueError("pieces must have distinct scores and hold the space mark at their start only")
        self.cutter = self._cutter()
        self.pair_cache: dict[tuple[str, str], bool] = {}
        self.chunk_cache: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.rank:
            if self.merge(p) == [p]:  # a piece that merging never makes is never a token
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()

    def _cutter(self) -> re.Pattern:
        """Chunks: a run of space marks, then characters of one group.

        Two characters are in one group if a chain of pieces has them side by
        side; between groups, and before a space mark, no piece spans the cut.
        """
        group: dict[str, str] = {}

        def root(c: str) -> str:
            while group.setdefault(c, c) != c:
                c = group[c]
            return c

        for p in self.rank:
            body = p.lstrip(META)
            for a, b in zip(body, body[1:], strict=False):
                group[root(b)] = root(a)
        members: dict[str, str] = {}
        for c in group:
            members[root(c)] = members.get(root(c), "") + c
        classes = [f"[{re.escape(m)}]+" for m in sorted(members.values(), key=len, reverse=True)]
        return re.compile(f"{META}*(?:{'|'.join([*classes, f'[^{META}]'])})|{META}+", re.DOTALL)

    def merge(self, text: str) -> list[str]:
        """Plain merging by score, for short strings only: checks of tokens and of pairs."""
        parts = list(text)
        rank = self.rank
        while len(parts) > 1:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of both tokens gives the two tokens again."""
        key = (left, right)
        found = self.pair_cache.get(key)
        if found is None:
            if len(self.pair_cache) >= PAIRS:
                self.pair_cache.clear()
            found = self.pair_cache[key] = self.merge(left + right) == [left, right]
        return found

    def tokens(self, chunk: str) -> list[str]:
        """Tokens of a chunk without runs of space marks, by backtracking."""
        n = len(chunk)
        starts: list[list[int] | None] = [None] * n  # ends of the matches longer than one from each position, ascending
        for end, length in self.automaton.iter(chunk):
            at = end + 1 - length
            if starts[at] is None:
                starts[at] = [end + 1]
            else:
                starts[at].append(end + 1)
        pairs = self.pair_cache
        failed = 0  # a bit for each position from which no continuation exists
        path: list[str] = []
        places: list[tuple[int, int]] = []  # of each token taken: where it begins, and the index of its end in starts (-1: one character)
        at, ends = 0, starts[0]
        index = len(ends) - 1 if ends else -1
        before = None
        while at < n:
            while index >= -1:
                end = ends[index] if index >= 0 else at + 1
                if not failed >> end & 1:
                    token = chunk[at:end]
                    if before is None:
                        break
                    fits = pairs.get((before, token))
                    if fits is None:
                        fits = self.compatible(before, token)
                    if fits:
                        break
                index -= 1
            if index >= -1:
                path.append(token)
                places.append((at, index))
                before, at = token, end
                if at < n:
                    ends = starts[at]
                    index = len(ends) - 1 if ends else -1
            else:
                # Whatever token leads here, the one before it must change.
                failed |= 1 << at
                if not path:
                    raise AssertionError("no tokenisation; the pair check is inconsistent")
                path.pop()
                at, index = places.pop()
                index -= 1
                ends = starts[at]
                before = path[-1] if path else None
        return path

    def to_ids(self, token: str) -> list[int]:
        found = self.ids.get(token)
        if found is not None:
            return [found]
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in token.encode("utf-8")]

    def chunk(self, chunk: str) -> list[int]:
        """Ids of one chunk: a run of space marks, then characters without any."""
        if len(chunk) == 1 and chunk != META:
            return self.to_ids(chunk)
        body = chunk.lstrip(META)
        marks = len(chunk) - len(body)
        ids: list[int] = []
        tokens = self.tokens((META if marks else "") + body) if body else []
        if tokens and marks and tokens[0] != META:
            marks -= 1
        elif tokens and marks:
            tokens = tokens[1:]
        while marks:
            size = next(k for k in range(min(marks, max(self.runs, default=1)), 0, -1) if k == 1 or k in self.runs)
            ids += [self.runs[size]] if size > 1 else self.to_ids(META)
            marks -= size
        known = self.ids
        for token in tokens:
            found = known.get(token)
            if found is None:
                ids += self.to_ids(token)
            else:
                ids.append(found)
        return ids

    def chunks(self, text: str) -> list[str]:
        return self.cutter.findall(META + text.replace(" ", META)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.chunk(c)]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, runs of byte pieces read as UTF-8, the dummy prefix taken off."""
        text = self._join(ids)
        first = next((i for i in ids if i not in self.control or i == self.unknown), None)
        return text[1:] if first is not None and self.pieces[first].startswith(META) else text

    def _join(self, ids: list[int]) -> str:
        out: list[str] = []
        held = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held = bytearray()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.control:
                out.append(self.pieces[i].replace(META, " "))
        if held:
            out.append(_utf8(bytes(held)))
        return "".join(out)

    def known(self, chunk: str) -> tuple[str, int, str]:
        """Joined decimal ids, their number, and the text they decode to, remembered for short chunks."""
        found = self.chunk_cache.get(chunk)
        if found is None:
            found = self.older.get(chunk)
        if found is None:
            ids = self.chunk(chunk)
            plain = [self.plain[i] for i in ids]
            found = (",".join(map(str, ids)), len(ids), self._join(ids) if None in plain else "".join(plain))
        if len(chunk) <= LONG_CHUNK:
            if len(self.chunk_cache) >= CACHE:
                self.older = dict(self.chunk_cache)
                self.chunk_cache.clear()
            self.chunk_cache[chunk] = found
        return found


def _utf8(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that fits nowhere."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """Ids and decoded text of every document.

    A null text counts as empty: no ids and an empty decoded text. Repeated rows
    each give a row; columns besides doc_id and text are not looked at.

    Returns doc_id, n_tokens, ids (decimal, comma-joined) and decoded. With
    ``with_ids=False`` the last two are replaced by their SHA-256 digests,
    ids_sha256 and decoded_sha256, so that no long value leaves a task.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *((n, pa.string()) for n in (("ids", "decoded") if with_ids else ("ids_sha256", "decoded_sha256")))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)

        def flushed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            out: list[tuple] = []
            held = 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cache = model.chunk_cache
                found = [cache.get(c) or model.known(c) for c in model.chunks(text or "")]
                ids = ",".join([f[0] for f in found])
                decoded = "".join([f[2] for f in found])[1:]
                if not with_ids:
                    ids, decoded = (hashlib.sha256(x.encode("utf-8")).hexdigest() for x in (ids, decoded))
                out.append((doc_id, sum([f[1] for f in found]), ids, decoded))
                held += len(ids) + len(decoded)
                if held > HELD_CHARS:
                    yield flushed(out)
                    out, held = [], 0
            if out:
                yield flushed(out)

    names = ("ids", "decoded") if with_ids else ("ids_sha256", "decoded_sha256")
    return own_columns(docs, "doc_id", "text").mapInArrow(lean(run), f"doc_id long, n_tokens long, {names[0]} string, {names[1]} string")


def with_digests(encoded: DataFrame) -> DataFrame:
    """What ``encode_documents`` returns, with the SHA-256 digests of ids and decoded in the place of decoded, which repeats the text."""
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
