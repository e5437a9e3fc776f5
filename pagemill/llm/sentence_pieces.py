"""SentencePiece encoding and decoding by streaming Viterbi.

The lattice of pieces over a text is walked once, one character at a time. Each position keeps
one back pointer, and only the window of the longest piece is needed to go on; whenever the
surviving back pointers of the window meet in one boundary, the ids up to it are committed and
forgotten. So a text of any length needs memory for a window and what is not yet decided.

Which back pointer a position keeps depends on the kind of model. For a unigram model it is the
one of the highest sum of scores. For a BPE model sums of scores do not give the ids of the
merges: there a piece may follow another only if merging both texts gives just these two, which
leaves one back pointer for each position, that of the merges of everything up to it.

Paths always meet between two characters that no piece holds side by side, such as a letter and a
space or a line end: the segments between are encoded on their own, each distinct one once in a
worker while it is met again.

Defined cases: null and empty texts have no ids and decode to the empty text; characters without
a piece become their bytes; ids of incomplete bytes decode to U+FFFD; U+2581 is the space sign of
the model, so it decodes to a space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import table, tidy
from pagemill.llm.segment_ids import SegmentIds
from pagemill.llm.words import hash_spans, slices, text_bytes

SIGN = "▁"
UNIGRAM, BPE = 1, 2             # model types: fixed values of the format
NORMAL, BYTE, USER = 1, 6, 4    # piece types: fixed values of the format
COMMIT_EVERY = 256              # positions between looks for a common boundary


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a model file and the streaming Viterbi over them."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        model.ParseFromString(proto)
        spec = model.normalizer_spec
        if model.trainer_spec.model_type not in (UNIGRAM, BPE) or spec.name != "identity" or spec.remove_extra_whitespaces:
            raise ValueError("unigram and BPE models with identity normalisation are supported")
        self.kind = model.trainer_spec.model_type
        self.prefix = spec.add_dummy_prefix
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        self.piece = [p.piece for p in model.pieces]
        self.score = [p.score for p in model.pieces]
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.unknown_score = min(p.score for p in model.pieces if p.type == NORMAL) - 10
        self.longest = max(map(len, self.id))
        self.chars = set("".join(self.id))
        # pieces by their characters from the last to the first, and the ASCII pairs that some
        # piece holds
        self.trie: dict = {}
        self.pairs = np.zeros((256, 256), bool)
        self.pairs[128:] = self.pairs[:, 128:] = True
        for p, number in self.id.items():
            node = self.trie
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = number
            plain = p.replace(SIGN, " ")
            for x, y in zip(plain, plain[1:]):
                if x.isascii() and y.isascii():
                    self.pairs[ord(x), ord(y)] = True
        self.pairs[128:, [ord(" "), ord("\n")]] = self.pairs[ord("\n"), :] = False
        if any(SIGN in p.lstrip(SIGN) or "\n" in p for p in self.id):
            raise ValueError("a piece crosses a space or a line end")
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SIGN, " ").encode() if p.type in (NORMAL, USER)
                    else " ⁇ ".encode() if p.type == 2 else b"" for p in model.pieces]
        self._fits: dict[int, bool] = {}

    # -- BPE: which pieces may follow each other
    def merged(self, text: str) -> list[str]:
        """The merges of a short text, one after the other."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.id.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.score[found] > best):
                    best, at = self.score[found], i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: int, b: int) -> bool:
        """Whether piece ``b`` can follow piece ``a`` (-1: nothing) in merges."""
        key = (a + 1) << 24 | b
        found = self._fits.get(key)
        if found is None:
            parts = [self.piece[x] for x in (a, b) if x >= 0]
            found = self._fits[key] = self.merged("".join(parts)) == parts
        return found

    def stream(self, text: str):
        """Yield (piece id, start, end) of a text as they are committed.

        ``piece[p]`` and ``back[p]`` are the last piece of the path to position ``base + p`` and
        where it starts; ``best`` the path's score (unigram)."""
        fits, known, score = self.fits, self._fits.get, self.score
        bpe = self.kind == BPE
        base, piece, back, best = 0, [-1], [0], [0.0]
        for j in range(1, len(text) + 1):
            ends = []       # pieces that end here, the shortest first
            node, i = self.trie, j
            while i > base:
                i -= 1
                node = node.get(text[i])
                if node is None:
                    break
                if "" in node:
                    ends.append((node[""], i))
            top = None
            if bpe:
                for found, i in reversed(ends):
                    last = piece[i - base]
                    ok = known((last + 1) << 24 | found)
                    if ok or ok is None and fits(last, found):
                        top = (found, i, 0.0)
                        break
            else:
                if not ends or ends[0][1] != j - 1:
                    ends.insert(0, (self.unknown, j - 1))
                for found, i in reversed(ends):
                    s = best[i - base] + (self.unknown_score if found == self.unknown else score[found])
                    if top is None or s > top[2]:
                        top = (found, i, s)
            piece.append(top[0])
            back.append(top[1])
            best.append(top[2])
            if (j - base) % COMMIT_EVERY == 0:
                low = self._common(back, base, j)
                if low > base:
                    yield from self._path(piece, back, base, low)
                    # what lies before the boundary is decided; its last piece still binds
                    cut = low - base
                    del piece[:cut], back[:cut], best[:cut]
                    base = low
        yield from self._path(piece, back, base, len(text))

    def _common(self, back: list, base: int, j: int) -> int:
        """The last boundary that the paths of all positions a piece can still start at share."""
        heads = set(range(max(base, j - self.longest), j + 1))
        while len(heads) > 1:
            last = max(heads)
            heads.remove(last)
            heads.add(max(base, back[last - base]))
        return heads.pop()

    @staticmethod
    def _path(piece: list, back: list, base: int, j: int):
        out = []
        while j > base:
            i = back[j - base]
            out.append((piece[j - base], i, j))
            j = i
        return reversed(out)

    def encode_segment(self, text: str) -> list[int]:
        """Ids of a text whose spaces are written as the space sign."""
        ids: list[int] = []
        at = 0
        while at < len(text):       # runs of characters with pieces; the others are bytes
            end = at
            while end < len(text) and text[end] in self.chars:
                end += 1
            for piece, i, j in self.stream(text[at:end]) if end > at else ():
                ids += [piece] if piece != self.unknown else self._bytes(text[at + i:at + j])
            if end < len(text):
                ids += self._bytes(text[end])
            at = end + 1
        return ids

    def _bytes(self, text: str) -> list[int]:
        return [self.byte[b] for b in text.encode()] if self.byte else [self.unknown]

    def encode_segments(self, segments: list[bytes]) -> list[list[int]]:
        return [self.encode_segment(x.decode().replace(" ", SIGN)) for x in segments]

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join([self.raw[i] for i in ids.tolist()])
        if self.prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


class Encoder:
    """Ids of whole texts from those of their segments."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.known = SegmentIds(self.pieces.encode_segments, np.uint16 if len(self.pieces.piece) <= 1 << 16 else np.uint32)

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's ids)."""
        texts = [(" " + x if self.pieces.prefix else x).replace(SIGN, " ") if x else "" for x in col.to_pylist()]
        buf, offsets = text_bytes(pa.array(texts, pa.large_string()))
        n = len(buf)
        if not n:
            return np.zeros(0, self.known.kind), np.zeros(len(texts) + 1, np.int64)
        cut = np.zeros(n + 1, bool)     # a segment begins here
        cut[offsets] = True
        cut[1:n] |= ~self.pieces.pairs[buf[:-1], buf[1:]]
        cut[n] = True
        bounds = np.flatnonzero(cut)
        start, end = bounds[:-1], bounds[1:]
        ids, size = self.known.ids(buf, start, end, hash_spans(buf, start, end))
        return ids, np.r_[0, np.cumsum(size)][np.searchsorted(start, offsets)]


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this model file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_ids, ids (little-endian unsigned 32-bit)."""
    path = path or model_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary())])

    @tidy
    def run(batches):
        for b in (x for batch in batches for x in slices(batch)):
            ids, bounds = encoder(path)(b.column("text"))
            ids = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)),
                                              pa.array([ids[s:e].tobytes() for s, e in zip(bounds, bounds[1:])], pa.binary())], schema=schema)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_ids long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of :func:`encode`: doc_id, n_ids, ids, text."""
    path = path or model_path()

    def run(batches):
        for b in batches:
            pieces = encoder(path).pieces
            texts = [pieces.decode(np.frombuffer(x or b"", "<u4")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_ids", "ids")), pa.array(texts, pa.string())],
                                             names=["doc_id", "n_ids", "ids", "text"])

    return encoded.select("doc_id", "n_ids", "ids").mapInArrow(run, "doc_id long, n_ids long, ids binary, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: doc_id, n_ids, ids_crc32 (as unsigned 32-bit ids) and
    the SHA-256 of the decoded text."""
    out = decode(encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))
