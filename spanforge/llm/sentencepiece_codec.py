"""SentencePiece encoding and decoding by a streaming Viterbi search, for BPE models with byte fallback.

Every prefix of a text has exactly one last piece: the one that follows the last piece of the shorter prefix
without a merge that byte-pair encoding would have made across or inside them. So the search keeps, for each
boundary, one backpointer, and needs only the boundaries within the longest piece. Ids are committed as soon as
the paths of all boundaries in that window meet in one boundary. In particular they meet where no piece of the
vocabulary crosses: before a word's space, and between a word and most punctuation. The search restarts there,
and the ids of the text between two such places are remembered. The ids equal those of the sentencepiece
library (see the tests).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, held, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MEMO, MEMO_CHARS, PAIRS = 150_000, 64, 1_000_000
STEP = 64
# Rows whose ids are held at a time.
ROWS = 256
ANY, NONE = -1, -2


class Codec:
    """The pieces of a model file, with encoding and decoding."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        self.texts = [model.id_to_piece(i) for i in range(self.size)]
        self.ids = {self.texts[i]: i for i in range(self.size) if not special(i)}
        self.score = {t: model.get_score(i) for t, i in self.ids.items()}
        self.bytes = {int(self.texts[i][1:-1], 16): i for i in range(self.size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.ids), default=1)
        if any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids):
            raise ValueError("a piece holds a space after another character: segments would not be independent")
        # marks that no piece holds after a letter or digit end a segment
        inside = {m for t in self.ids for m in re.findall(r"(?<=[^\W_])[\W_]", t)}
        ends = re.escape("".join(c for c in map(chr, range(128)) if not c.isalnum() and c != " " and c not in inside))
        self.segments = re.compile(f" *[^\\W_]+(?=[{ends} ]|\\Z)| *[^ ]+| +")
        # pieces that are their own encoding, as a trie: char -> (node below, piece that ends here or NONE)
        self.live = {t: i for t, i in self.ids.items() if self.merge(t) == [t]}
        self.root: dict[str, tuple[dict, int]] = {}
        for t, i in self.live.items():
            node = self.root
            for c in t[:-1]:
                node = node.setdefault(c, ({}, NONE))[0]
            node[t[-1]] = (node[t[-1]][0] if t[-1] in node else {}, i)
        if any(piece == NONE for _, piece in self.root.values()):
            raise ValueError("a piece begins with a character that is no piece: prefixes would have no path")
        high = {i for b, i in self.bytes.items() if b >= 128}
        self.high = high
        shown = {i: chr(b) for b, i in self.bytes.items() if b < 128}
        self.shown = [shown.get(i, "" if model.is_control(i) else self.texts[i].replace(SPACE, " ")) for i in range(self.size)]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.pairs: dict[int, dict[int, bool]] = {}
        self.n_pairs = 0
        self.memo: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, text: str) -> list[str]:
        """Byte-pair encoding of a short text: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, before: int, piece: int) -> bool:
        """Whether two pieces stay apart where they meet."""
        self.n_pairs += 1
        if self.n_pairs > PAIRS:
            self.pairs, self.n_pairs = {}, 1
        a, b = self.texts[before], self.texts[piece]
        ok = self.pairs.setdefault(before, {})[piece] = self.merge(a + b) == [a, b]
        return ok

    def bytes_of(self, char: str) -> list[int]:
        """The ids of a character without a piece: its bytes, or the unknown one."""
        found = [self.bytes.get(b) for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown] if None in found else found

    def segment(self, text: str) -> tuple[int, ...]:
        """The ids of a segment, remembered if it is short; what isn't asked for is forgotten in two steps."""
        if (got := self.old.get(text)) is None:
            search, marked = StreamingViterbi(self), text.replace(" ", SPACE)
            got = (*search.feed(marked), *search.finish())
        if len(text) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.old, self.memo = self.memo, {}
            self.memo[text] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; none for null or empty."""
        if not text:
            return []
        out: list[int] = []
        extend = out.extend
        for s in self.segments.findall(" " + (text.replace(SPACE, " ") if SPACE in text else text)):
            got = self.memo.get(s)
            extend(self.segment(s) if got is None else got)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        if self.high.isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            raw = b"".join(bytes((self.byte_of[i],)) if i in self.byte_of else self.shown[i].encode("utf-8", "surrogatepass") for i in ids)
            text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class StreamingViterbi:
    """Encodes a text that comes in parts; holds the boundaries that no committed path has passed."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.text = ""  # from the last committed boundary on
        # for each boundary of text: the last piece before it (ANY: a character without a piece, or the start,
        # which anything may follow; NONE: no path) and where that piece begins
        self.last, self.back = [ANY], [0]
        self.at = 0  # pieces that begin before this boundary have been tried

    def feed(self, part: str) -> list[int]:
        """Ids committed by these characters."""
        out: list[int] = []
        for i in range(0, len(part), STEP):
            self._add(part[i : i + STEP])
            self._search(len(self.text) - self.codec.longest + 1)
            if self.at >= STEP:
                out += self._commit(self._meeting())
        return out

    def finish(self) -> list[int]:
        """The ids that are left."""
        self._search(len(self.text))
        return self._commit(len(self.text))

    def _add(self, part: str) -> None:
        self.text += part
        self.last += [NONE] * len(part)
        self.back += [0] * len(part)

    def _search(self, until: int) -> None:
        """Try the pieces that begin at the boundaries before `until`."""
        c, text, last, back = self.codec, self.text, self.last, self.back
        pairs, root, nothing = c.pairs, c.root, {}
        for j in range(self.at, until):
            before = last[j]
            if before == NONE:
                continue
            known, node, i = pairs.get(before, nothing), root, j
            for char in text[j : j + c.longest]:
                if (below := node.get(char)) is None:
                    if i == j:  # a character without a piece
                        last[j + 1], back[j + 1] = ANY, j
                    break
                i += 1
                node, piece = below
                if piece >= 0:
                    if before >= 0:
                        ok = known.get(piece)
                        if not (c.follows(before, piece) if ok is None else ok):
                            continue
                    last[i], back[i] = piece, j
        self.at = max(self.at, until)

    def _meeting(self) -> int:
        """The last boundary that the paths of all boundaries reached share."""
        alive = {i for i in range(self.at, len(self.text) + 1) if self.last[i] != NONE}
        while len(alive) > 1:
            i = max(alive)
            alive.remove(i)
            alive.add(self.back[i])
        return alive.pop()

    def _commit(self, end: int) -> list[int]:
        out, i, last, back = [], end, self.last, self.back
        while i > 0:
            j, piece = back[i], last[i]
            if piece >= 0:
                out.append(piece)
            else:
                out += reversed(self.codec.bytes_of(self.text[j:i]))
            i = j
        out.reverse()
        self.text, self.last, self.back = self.text[end:], last[end:], [max(0, j - end) for j in back[end:]]
        self.at -= end
        return out


def codec(path: str = MODEL) -> Codec:
    """The worker's codec of a model file."""
    return held(("pieces", path), lambda: Codec(path))


def encode(text: Column, path: str = MODEL) -> Column:
    """Ids of a whole text as an array of int; empty for null."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for texts in batches:
            yield pd.Series([c.encode(t) for t in texts], dtype=object)

    return ids(text)


def decode(ids: Column, path: str = MODEL) -> Column:
    """The text of an array of ids; null for null."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for lists in batches:
            yield pd.Series([None if x is None else c.decode(x.tolist() if hasattr(x, "tolist") else list(x)) for x in lists], dtype=object)

    return texts(ids)


def encode_documents(docs: DataFrame, text: str = "text", path: str = MODEL, ids: str = "token_ids", count: str = "n_tokens", check: str = "round_trip") -> DataFrame:
    """docs with the ids of each whole text, their number, and whether decoding them gives the text back.

    Null and empty texts have no ids, repeated rows stay repeated, a text of any length is encoded whole, and an empty
    table gives no rows. The round trip fails where a text holds U+2581 itself, which SentencePiece
    reads as a space. The three columns come last, with an underscore before a name that docs has.
    """
    small_batches(docs.sparkSession)
    ids, count, check = fresh(docs, ids, count, check)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(text).to_pylist()
                found = [c.encode(t) for t in texts]
                same = [c.decode(x) == (t or "") for x, t in zip(found, texts)]
                added = [pa.array(found, pa.list_(pa.int32())), pa.array(map(len, found), pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, ids, count, check])

    added = StructType.fromDDL(f"`{ids}` array<int>, `{count}` bigint, `{check}` boolean").fields
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))
