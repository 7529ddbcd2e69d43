"""Packing documents into fixed-length training sequences by the sum-of-squares rule.

Every document becomes its token ids plus id 0. One longer than a sequence is cut into full pieces, the
first of which holds the rest. Pieces are dealt to groups of a few thousand; each group is packed on its
own, longest piece first: of the open sequences with room, a piece goes to that gap for which the squared
counts of open sequences per gap add up to least, and opens a sequence only if none has room. A group keeps
counts per gap, so a step costs one pass over at most ``size`` numbers, whatever the corpus holds. Groups
leave a sequence or two less than full each.

:func:`pack` gives checksums of the pieces' ids, :func:`pack_ids` the ids themselves and :func:`sequences` the filled
sequences. Where ids are kept they are written once and only lengths go to the groups, so that a group's memory does not
depend on how long the documents are.

Null or empty text gives the single id 0. Repeated rows are packed each on its own. An empty table gives an
empty result. The input should be a table scan: dealing counts rows in scan order, which a rerun repeats.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import own_columns, written

SIZE = 2048
#: Documents to a group.
GROUP = 8000
PIECES = "bucket long, doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_WITH_IDS = "place long, bucket long, doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
#: What is told of a piece.
PIECE = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}

#: Beyond these code points, with a special token's text or a very long run of white space, only the reference tokenizer
#: is used: elsewhere both libraries cut words alike, and the rank file gives the same ids several times faster.
_OTHER = re.compile("[^\x00-ɏ]|<\\|endoftext\\|>|\\s{4096}")


class Encoder:
    """Token ids of a text under the byte-level BPE vocabulary, as the ``tokenizers`` library gives them."""

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and not _OTHER.search(text):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


_ENCODERS: dict[tuple, Encoder] = {}


def public_encoder(name: str = "byte_bpe_50k") -> Encoder:
    """The encoder of a vocabulary file of ``public_tokenizers``, loaded once to a process."""
    if (name,) not in _ENCODERS:
        import public_tokenizers

        _ENCODERS[(name,)] = Encoder(public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN)
    return _ENCODERS[(name,)]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones but the first."""
    first = n % size
    starts = ([0] if first else []) + list(range(first, n, size))
    return [(s, first if s == 0 and first else size) for s in starts]


def token_pieces(docs: DataFrame, groups: int, size: int = SIZE, vocabulary: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """One row per piece, dealt to ``groups`` buckets; ``with_ids`` adds the ids and ``place``, a number of the piece's own.
    That depends on how the scan was cut into tasks, so such rows are to be written before they are used twice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, dealt = public_encoder(vocabulary), None
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[tuple] = []
            kept = [np.empty(0, np.int32)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encoder.ids(text.as_py() or ""), 0], dtype="<u4")
                if dealt is None:  # tasks begin at different buckets
                    dealt = zlib.crc32(f"{doc_id}:{len(ids)}".encode())
                for piece, (start, length) in enumerate(cut(len(ids), size)):
                    rows.append((dealt % groups, doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    dealt += 1
                kept.append(ids.astype(np.int32))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "doc_id", "piece", "start", "length", "ids_crc32"])
            if with_ids:  # the pieces of a document lie one behind the other
                ends = np.concatenate([[0], np.cumsum(out.column("length").to_numpy())]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept)))
                places = pa.array(np.arange(place, place + len(rows)))
                place += len(rows)
                out = pa.RecordBatch.from_arrays([places, *out.columns, lists], names=["place", *out.schema.names, "ids"])
            yield out

    return own_columns(docs, "doc_id", "text").mapInArrow(run, PIECES_WITH_IDS if with_ids else PIECES)


def sum_of_squares(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; sequences are numbered from 0. Pieces go longest first. Opening a sequence is never
    weighed against the open ones: the rule decides among those that have room, and a new one is made if none has, so that
    there are as few as can be. Of equal changes the fullest sequence is taken, and of those the one opened last."""
    order = np.argsort(-lengths, kind="stable")
    n_open = np.zeros(size + 1, dtype=np.int64)  # sequences filled to a level, but for full ones
    filled: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset, made = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), 0
    for i in order.tolist():
        a = int(lengths[i])
        levels = n_open[1 : size - a + 1]
        level = 0
        if levels.any():
            # the sum changes by (n - 1)^2 - n^2 where the sequence leaves, and (m + 1)^2 - m^2 where it arrives
            change = 2 * n_open[a + 1 : size + 1] + 1 - (2 * levels - 1)
            change[-1] = 1 - 2 * levels[-1]  # a full sequence is not open
            change[levels == 0] = np.iinfo(np.int64).max
            level = len(change) - int(np.argmin(change[::-1]))  # of equals, the fullest
        if level:
            which = filled[level].pop()
            n_open[level] -= 1
        else:
            which, made = made, made + 1
        sequence[i], offset[i] = which, level
        if level + a < size:
            n_open[level + a] += 1
            filled[level + a].append(which)
    return sequence, offset


def _placed(pieces: DataFrame, carried: dict[str, str], size: int) -> DataFrame:
    """The ``carried`` columns of the pieces, with sequence and offset."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        sequence, offset = sum_of_squares(rows.column("length").to_numpy(), size)
        first = rows.column("bucket")[0].as_py() << 40
        return rows.select(list(carried)).append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{name} {kind}" for name, kind in carried.items())
    return pieces.groupBy("bucket").applyInArrow(run, f"{schema}, sequence_id long, offset long")


def _groups(docs: DataFrame, group: int) -> int:
    return max(1, -(-docs.count() // group))


def pack(docs: DataFrame, size: int = SIZE, group: int = GROUP, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece with its sequence and offset."""
    return _placed(token_pieces(docs, _groups(docs, group), size, vocabulary), PIECE, size)


def pack_ids(docs: DataFrame, size: int = SIZE, group: int = GROUP, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """The rows of :func:`pack` with the token ids of each piece."""
    pieces = written(token_pieces(docs, _groups(docs, group), size, vocabulary, with_ids=True), "token-pieces")
    placed = _placed(pieces.select("bucket", "place", "length"), {"place": "long"}, size)
    return pieces.join(placed, "place").select(*PIECE, "sequence_id", "offset", "ids")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, pieces): the token ids of each sequence of :func:`pack_ids`, and the pieces that it is made of. A
    sequence is never longer than the size that it was packed for."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids")
    return whole.select("sequence_id", ids, F.transform("parts", lambda p: p.dropFields("ids")).alias("pieces"))
