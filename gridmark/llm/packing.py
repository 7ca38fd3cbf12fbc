"""Packing of documents into token sequences by order-preserving dynamic programming.

Tasks tokenise their documents in order and look at the token stream in blocks.  Inside a block the
cuts are chosen among document ends, sentence ends and, at a price, single tokens, so that padding
plus the price of cuts inside documents is least; the best previous cut of every place is the minimum
of a sliding window, kept by a monotone queue.  A block's last cut is not fixed: what follows the last
full sequence moves on to the next block, and only the end of a task's stream is closed, by sequences
of powers of two, which need no padding.  Nothing is shuffled, and a task holds one block of tokens.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 2048
#: Tokens of a block; a block ends at a document.
BLOCK_TOKENS = 1 << 19
#: Prices of cuts inside a document, in padded tokens.
SENTENCE_PRICE, TOKEN_PRICE = 1.0, 6.0
#: Where neither document nor sentence ends, a cut may still be made at every so many tokens.
TOKEN_STRIDE = 32
END_ID = 1


def choose_cuts(ends: np.ndarray, prices: np.ndarray, limit: int) -> list[int]:
    """Places among ``ends`` at which to cut so that padding and prices are least.

    ``ends`` are increasing and at most ``limit`` apart, as two neighbouring cuts are.  What follows
    the last cut, at most ``limit`` tokens, stays open and costs nothing yet.
    """
    place, price = [0, *ends.tolist()], [0.0, *prices.tolist()]
    best, back = [0.0] * len(place), [0] * len(place)
    queue: deque[int] = deque([0])  # by place; best + place increases, so the first is the best cut before
    for i in range(1, len(place)):
        here = place[i]
        while here - place[queue[0]] > limit:
            queue.popleft()
        j = back[i] = queue[0]
        best[i] = best[j] + place[j] + limit - here + price[i]
        while queue and best[queue[-1]] + place[queue[-1]] >= best[i] + here:
            queue.pop()
        queue.append(i)
    i = min((i for i in range(len(place) - 1) if place[-1] - place[i] <= limit), key=best.__getitem__)
    cuts = []
    while i:
        cuts.append(place[i])
        i = back[i]
    return cuts[::-1]


def _powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class _Coder:
    """Token ids of texts.  Latin texts go through the faster of two public readers of one vocabulary.

    The two agree where character classes are old and settled (code points below 0x250); any other
    text takes the slower, defining one.  Strings of added tokens in a text are ordinary text unless
    ``added``: then they are the one id the definition gives them, and such texts take the slower one.
    """

    def __init__(self, definition: str, ranks: str | None, pattern: str, added: bool = False):
        import base64

        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(definition)
        self.slow.encode_special_tokens = not added
        strange = [re.escape(t.content) for t in self.slow.get_added_tokens_decoder().values()] if added else []
        self.other = re.compile("|".join(["[^\x00-\u024f]", *strange]))
        self.plain = not strange
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and (self.plain and text.isascii() or not self.other.search(text)):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def _sentence_ends(coder_vocab_size: int, definition: str) -> np.ndarray:
    """Marks ids whose text ends a sentence or a line."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(definition)
    ends = np.zeros(coder_vocab_size, bool)
    for token, i in t.get_vocab().items():
        if i < coder_vocab_size and token.endswith((".", "!", "?", "Ċ")):  # U+010A stands for the line feed byte
            ends[i] = True
    return ends


class _Block:
    """Documents whose tokens are not yet placed, and the pieces made of them."""

    def __init__(self, limit: int, ends: np.ndarray, first_sequence: int):
        self.limit, self.ends, self.sequence = limit, ends, first_sequence
        self.docs: list[list] = []  # key, ids, tokens already placed
        self.size = 0

    def add(self, key, ids: np.ndarray) -> None:
        self.docs.append([key, ids, 0])
        self.size += len(ids)

    def _places(self) -> tuple[np.ndarray, np.ndarray]:
        places, prices, at = [], [], 0
        for _, ids, done in self.docs:
            n = len(ids) - done
            inside = np.flatnonzero(self.ends[ids[done:-1]]) + 1
            step = np.arange(TOKEN_STRIDE, n, TOKEN_STRIDE)
            cost = np.full(n + 1, np.inf)
            cost[step] = TOKEN_PRICE
            cost[inside] = SENTENCE_PRICE
            cost[n] = 0.0
            here = np.flatnonzero(cost < np.inf)
            places.append(here + at)
            prices.append(cost[here])
            at += n
        return np.concatenate(places), np.concatenate(prices)

    def flush(self, last: bool) -> list[tuple]:
        """Pieces (key, start, length, crc, tokens of the document, sequence, offset); keeps the open end unless ``last``."""
        if not self.docs:
            return []
        places, prices = self._places()
        cuts = choose_cuts(places, prices, self.limit)
        if last:
            at = cuts[-1] if cuts else 0
            for n in _powers_of_two(int(places[-1]) - at):
                at += n
                cuts.append(at)
        out, at, pos = [], 0, 0
        for cut in cuts:
            offset = 0
            while at < cut:
                key, ids, done = self.docs[pos]
                take = min(cut - at, len(ids) - done)
                out.append((key, done, take, zlib.crc32(ids[done:done + take].astype("<u4").tobytes()), len(ids), self.sequence, offset))
                at += take
                offset += take
                self.docs[pos][2] += take
                if self.docs[pos][2] == len(ids):
                    pos += 1
            self.sequence += 1
        self.docs = self.docs[pos:]
        self.size = sum(len(d[1]) - d[2] for d in self.docs)
        return out


def pack(docs: DataFrame, definition: str, ranks: str | None = None, pattern: str = "", key: str = "doc_id", text: str = "text",
         limit: int = SEQUENCE, end_id: int = END_ID, added: bool = False) -> DataFrame:
    """Pieces ``(key, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of all documents.

    ``definition`` (and ``ranks``, the same vocabulary) are tokenizer files that every worker has; a
    document is its ids and ``end_id``; strings of added tokens in a text are those tokens if ``added``.  Null and empty texts are the end id alone.  Repeated rows and
    null keys are packed like any other.  A sequence has at most ``limit`` tokens and is padded to
    ``limit`` unless its size is a power of two.
    """
    schema = docs.select(key).schema
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, block = None, None
        names = schema.names

        def made(pieces: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*pieces)) if pieces else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], names)

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            if coder is None:
                coder = _Coder(definition, ranks, pattern, added)
                block = _Block(limit, _sentence_ends(coder.slow.get_vocab_size(), definition), 0)
            for row in range(batch.num_rows):
                if block.sequence == 0 and not block.docs and row == 0:
                    block.sequence = batch.column(2)[0].as_py() << 33
                ids = np.append(coder(batch.column(1)[row].as_py() or ""), np.uint32(end_id))
                block.add(batch.column(0)[row].as_py(), ids)
                if block.size >= BLOCK_TOKENS:
                    yield made(block.flush(False), kind)
        if block is not None:
            yield made(block.flush(True), kind)

    return docs.select(F.col(key), F.col(text), F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, schema)
