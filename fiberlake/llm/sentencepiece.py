"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

Spaces become the marker U+2581 and one marker goes in front.  Characters that no piece has are written as byte
pieces.  Decoding joins pieces and bytes, turns markers into spaces and drops the one in front; a text's own U+2581 is
written as bytes, so that any text comes back exactly.  Where no piece has a marker after another character, texts are
cut at words without changing the best path, and words met before are looked up.

The vocabulary is a parameter.  Scores of unigram models are used as they are; a BPE model has merge ranks instead,
which count as log(1 / (rank + 1)).

Edge cases: null and empty texts have no tokens; repeated rows are encoded alike; a null doc_id stays null; very long
words are encoded whole (time grows with their length); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiberlake.llm.common import slices, text_of

MARK = "▁"
_CACHE = 300_000
_MET: dict[str, dict[str, bytes]] = {}  # words met by this worker, by vocabulary
_UNKNOWN = 10.0  # how much worse than the worst piece a character written in bytes is


class DoubleArray:
    """Trie over bytes: node s goes to base[s] + byte + 1 if check of that is s; value[s] is the id that ends at s, or -1."""

    def __init__(self, keys: dict[bytes, int]):
        tree: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, value in keys.items():
            at = 0
            for b in key:
                to = tree[at].get(b)
                if to is None:
                    to = tree[at][b] = len(tree)
                    tree.append({})
                    ends.append(-1)
                at = to
            ends[at] = value
        size = 1 << 12
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], value[0] = 0, ends[0]
        free, wide, queue = 257, 257, [(0, 0)]  # lower places can be reached from no base
        for node, place in queue:
            children = tree[node]
            if not children:
                continue
            low = min(children)
            while check[free] != -1:
                free += 1
                if free >= len(check):
                    base += [0] * len(base)
                    check += [-1] * len(check)
                    value += [-1] * len(value)
            # one child fits any hole; where families no longer fit, the search for them moves on
            at, tries = (free, 0) if len(children) == 1 else (max(free, wide), 0)
            while True:
                b = at - low - 1
                while b + 258 >= len(check):
                    base += [0] * len(base)
                    check += [-1] * len(check)
                    value += [-1] * len(value)
                if b >= 0 and all(check[b + c + 1] == -1 for c in children):
                    break
                at += 1
                tries += 1
            if tries > 32:
                wide = at - 16
            base[place] = b
            for c, child in children.items():
                check[b + c + 1], value[b + c + 1] = place, ends[child]
            queue += [(child, b + c + 1) for c, child in children.items()]
        check[0] = -2  # no step leads back to the root
        self.base, self.check, self.value = (array("i", x) for x in (base, check, value))
        self._lists: tuple[list[int], list[int], list[int]] | None = None

    def tables(self) -> tuple[list[int], list[int], list[int]]:
        """base, check and value as lists, which Python reads faster; arrays are what travels."""
        if self._lists is None:
            self._lists = [*self.base], [*self.check], [*self.value]
        return self._lists

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lists": None}


def _cuts(pieces: list[str]) -> re.Pattern:
    """Parts of a text that no piece reaches across: at words, at line ends, and before signs that follow no letter in any piece."""
    if any(MARK in p.lstrip(MARK) for p in pieces):
        return re.compile("(?s).+")
    after = {b for p in pieces for a, b in zip(p, p[1:]) if a.isalpha()}
    signs = "".join(re.escape(c) for c in ",.;:!?|#%&$*" if c not in after)
    line = "" if any("\n" in p for p in pieces) else "\n"
    early = f"{MARK}*[^\\W\\d_]+(?=[{signs}])|" if signs else ""
    return re.compile(f"{early}{MARK}*[^{MARK}{line}]+|{MARK}+" + (f"|{line}+" if line else ""))


class Unigram:
    """pieces: text of each id; scores: log scores; byte_ids: the ids of bytes 0 to 255; special ids are no pieces of a text."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: set[int]):
        skip = special | set(byte_ids)
        self.scores, self.byte_ids = scores, byte_ids
        usable = {p.encode(): i for i, p in enumerate(pieces) if i not in skip and p}
        self.trie = DoubleArray(usable)
        self.floor = min((scores[i] for i in usable.values()), default=0.0) - _UNKNOWN
        self.bytes_of = [b"" if i in special else p.encode() for i, p in enumerate(pieces)]
        for b, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([b])
        self.byte_set = set(byte_ids)
        self.cut = _cuts([p for i, p in enumerate(pieces) if i not in skip])

    def viterbi(self, word: str) -> list[int]:
        data = word.encode()
        n = len(data)
        best, start, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        scores, floor = self.scores, self.floor
        base, check, value = self.trie.tables()
        for i in range(n):
            here = best[i]
            if here == -math.inf:  # within a character
                continue
            first = data[i]
            wide = i + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
            single, at = False, 0
            for j in range(i, n):  # down the trie; every key that ends on the way is a piece
                to = base[at] + data[j] + 1
                if check[to] != at:
                    break
                at = to
                p = value[to]
                if p >= 0:
                    j += 1
                    single |= j == wide
                    score = here + scores[p]
                    if score > best[j]:
                        best[j], start[j], piece[j] = score, i, p
            if not single and here + floor > best[wide]:
                best[wide], start[wide], piece[wide] = here + floor, i, -1
        out, at = [], n
        while at:
            out += [piece[at]] if piece[at] >= 0 else [self.byte_ids[b] for b in reversed(data[start[at] : at])]
            at = start[at]
        return out[::-1]

    def encode_packed(self, text: str, cache: dict[str, bytes]) -> bytes:
        """Ids as 32-bit little-endian integers."""
        if not text:
            return b""
        own = MARK in text
        parts = text.split(MARK) if own else [text]
        out = []
        for k, part in enumerate(parts):
            if k:
                out.append(np.array([self.byte_ids[b] for b in MARK.encode()], "<i4").tobytes())
            words = self.cut.findall((MARK if k == 0 else "") + part.replace(" ", MARK))
            found = [*map(cache.get, words)]
            if None in found:
                for i, ids in enumerate(found):
                    if ids is None:
                        word = words[i]
                        ids = found[i] = cache.get(word) or np.array(self.viterbi(word), "<i4").tobytes()
                        if len(word) <= 64:
                            if len(cache) >= _CACHE:
                                cache.clear()
                            cache[word] = ids
            out += found
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text, {}), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Markers within pieces become spaces; one made of byte pieces was the text's own and stays."""
        space = MARK.encode()
        body = b"".join([self.bytes_of[i] if i in self.byte_set else self.bytes_of[i].replace(space, b" ") for i in ids])
        return body.decode(errors="replace").removeprefix(" ")


def load(path: str) -> Unigram:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces, scores = [model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
    if all(s <= 0 and s == int(s) for i, s in enumerate(scores) if i not in special):  # merge ranks of a BPE model
        scores = [-math.log(1 - s) for s in scores]
    return Unigram(pieces, scores, byte_ids, special)


def encode_documents(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_sha256 (of 32-bit little-endian ids), round_trip, and the ids if wanted."""
    sent = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = sent.value, _MET.setdefault(path, {})
        plain = np.array([b.replace(MARK.encode(), b" ") if i not in model.byte_set else b for i, b in enumerate(model.bytes_of)], object)
        is_byte = np.zeros(len(plain), bool)
        is_byte[model.byte_ids] = True
        for batch in batches:
            for part in slices(batch, "text", 1 << 22):
                rows = []
                for text in part.column("text").to_pylist():
                    packed = model.encode_packed(text, cache)
                    found = np.frombuffer(packed, "<i4")
                    back = b"".join(plain[found].tolist())
                    rows.append((len(found), int(is_byte[found].sum()), hashlib.sha256(packed).hexdigest(), back == (b" " + text.encode() if text else b""), found if ids else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32())][: 4 + ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip", "ids"][: 5 + ids])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * ids)
