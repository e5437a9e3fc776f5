"""Cost-balanced packing of documents into training sequences.

A document's ids are its tokens and the id that ends it. Its estimated cost is linear in its
tokens for the feed-forward part and quadratic for attention. Ids are cut into pieces of at most
one sequence; pieces are dealt by hash into groups of about ``GROUP_TOKENS`` tokens, so that no
task holds more, whatever a document, source or copy holds. Within a group there are as many
sequences as its tokens fill. Pieces go in descending order to the sequence of lowest cost that
has room; a piece that no sequence has room for is cut to fill the emptiest ones. So less than
one sequence of padding is left in a group.

Defined cases: null and empty texts hold the end id only; rows of one id are packed each by
itself; ids may be null.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import rows_to_batches, table, tidy
from pagemill.llm.segment_ids import SegmentIds
from pagemill.llm.words import hash_spans, slices, split_words

SEQUENCE = 2048
END_ID = 1
GROUP_TOKENS = 1 << 19
CHARS_PER_TOKEN = 3.5       # only sets the number of groups
LINEAR, QUADRATIC = 12 * 1024, 1    # cost of n tokens: LINEAR * n + QUADRATIC * n * n

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of whole texts from the ids of their words. It needs a tokenizer that lower-cases,
    drops white space, works within words and parts letters from punctuation, so that the ids of a
    text are those of its words in turn, and those of a word the ones without and of its last full
    stop or comma. A worker keeps the ids of words that it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.known = SegmentIds(lambda words: [x.ids for x in encode([x.decode() for x in words], add_special_tokens=False)], self.kind)

    def __call__(self, col) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's ids)."""
        # names of special tokens count as such only as they are written
        w = split_words(col, lower=True)
        if (w.buf == ord("<")).any():
            w = split_words(col)
        last, before = w.buf[w.end - 1], w.buf[np.maximum(w.end - 2, 0)] | 0x20
        tail = np.flatnonzero(((last == ord(".")) | (last == ord(","))) & (w.end - w.start > 1) & (before >= ord("a")) & (before <= ord("z")))
        start = np.sort(np.concatenate([w.start, w.end[tail] - 1]))
        end = w.end.copy()
        end[tail] -= 1
        end = np.sort(np.concatenate([end, w.end[tail]]))
        first = w.first + np.searchsorted(tail, w.first)
        ids, n = self.known.ids(w.buf, start, end, hash_spans(w.buf, start, end))
        return ids, np.r_[0, np.cumsum(n)][first]


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's tokenizer of this file."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


PIECES = "doc_id long, start long, doc_tokens long, ids binary"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def token_pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Documents as pieces of at most ``sequence`` ids (unsigned, in the tokenizer's width)."""

    @tidy
    def run(batches):
        def rows():
            for b in (x for batch in batches for x in slices(batch)):
                encode = word_ids(path)
                ids, bounds = encode(b.column("text"))
                for doc, s, e in zip(b.column("doc_id").to_pylist(), bounds[:-1], bounds[1:]):
                    own = np.append(ids[s:e], encode.kind(end_id))
                    for at in range(0, len(own), sequence):
                        yield doc, at, len(own), own[at:at + sequence].tobytes()

        yield from rows_to_batches(rows(), _PIECES_ARROW, 512)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def assign(sizes: np.ndarray, sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Pack pieces of these sizes (none over ``sequence``): (piece, start within it, length,
    sequence number, offset there)."""
    count = -(-int(sizes.sum()) // sequence)
    used, cost = np.zeros(count, np.int64), np.zeros(count)
    out = []

    def put(piece, start, n, to):
        out.append((piece, start, n, int(to), int(used[to])))
        used[to] += n
        cost[to] += LINEAR * n + QUADRATIC * n * n

    order = np.argsort(-sizes, kind="stable")
    full = int((sizes == sequence).sum())
    for to, piece in enumerate(order[:full]):
        put(int(piece), 0, sequence, to)
    for piece in order[full:]:
        start, rest = 0, int(sizes[piece])
        while rest:
            room = sequence - used[full:]
            fits = room >= rest
            if fits.any():
                to = full + int(np.argmin(np.where(fits, cost[full:], np.inf)))
                n = rest
            else:
                to = full + int(np.argmax(room))
                n = int(room[to - full])
            put(int(piece), start, n, to)
            start, rest = start + n, rest - n
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                   sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian
    unsigned 32-bit)."""
    path = path or tokenizer_path()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chars = src.agg(F.sum(F.length("text"))).first()[0] or 0
    n_groups = max(1, round(chars / CHARS_PER_TOKEN / GROUP_TOKENS))
    pieces = token_pieces(src, path, sequence, end_id).withColumn(
        "grp", F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(n_groups)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def pack_group(key, t):
        kind = word_ids(path).kind
        width = np.dtype(kind).itemsize
        docs_, starts, totals = (t.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        blobs = t.column("ids").to_pylist()
        # a stable order, whatever order the rows arrived in
        order = sorted(range(len(blobs)), key=lambda i: (docs_[i] is None, docs_[i] or 0, starts[i], blobs[i]))
        sizes = np.array([len(blobs[i]) // width for i in order], np.int64)

        def rows():
            for piece, start, n, to, offset in assign(sizes, sequence):
                i = order[piece]
                ids = np.frombuffer(blobs[i], kind)[start:start + n].astype("<u4")
                yield docs_[i], starts[i] + start, n, totals[i], (key[0].as_py() << 32) + to, offset, ids.tobytes()

        return pa.Table.from_batches(rows_to_batches(rows(), schema, 512), schema)

    return pieces.groupBy("grp").applyInArrow(
        pack_group, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def query(spark, sf_dir: str) -> DataFrame:
    """Contract rows of :func:`pack_documents` over all documents."""
    out = pack_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
