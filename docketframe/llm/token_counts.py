"""Token counts of whole texts under a byte-level BPE tokenizer, without making token ids.

A pre-token (what the tokenizer's own pattern cuts a text into) always gives the same number of pieces. So a text's count
is the sum, over its distinct pre-tokens, of frequency times pieces. Each task keeps a table of the pieces of the
pre-tokens it has met, counts new ones once, and joins it to the pre-token frequencies of every document it reads. The
table is started anew when it reaches ``max_known`` entries, so its memory has a bound; counts do not depend on it.

The join is inside the task and not a shuffle: a document has about 320 distinct pre-tokens, which as rows would be
several times the input (see the README for figures), while a task meets most of its pre-tokens again and again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

# Fixed value: the pre-token pattern of the byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters that every Unicode version and both pattern libraries put into the same classes.
ODD = regex.compile("[^\t\n\r\x20-\x7e\xa1-ſ–-…]")


class PieceCounter:
    """Counts the tokens of texts; keeps the pieces of known pre-tokens."""

    def __init__(self, definition: str, max_known: int) -> None:
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.max_known = max_known
        self.known: dict[str, int] = {}
        self.findall = regex.compile(PATTERN).findall
        own = self.tokenizer.pre_tokenizer
        self.by_pattern = isinstance(own, pre_tokenizers.ByteLevel) and not own.add_prefix_space and own.use_regex and self.tokenizer.normalizer is None
        self.spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [token.content for token in added]
        plain = not any(token.lstrip or token.rstrip or token.single_word or token.normalized for token in added)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).split if plain and self.special else None

    def pieces(self, pre_token: str) -> int:
        found = self.known.get(pre_token)
        if found is None:
            if len(self.known) >= self.max_known:
                self.known.clear()
            found = self.known[pre_token] = len(self.tokenizer.model.tokenize(self.spell(pre_token)[0][0]))
        return found

    def count(self, text: str) -> int:
        """Tokens of the whole text; a special token's string counts as that one token."""
        if not self.by_pattern or not text:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts, specials = [text], 0
        if any(token in text for token in self.special):
            if self.split is None:
                return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
            parts = self.split(text)
            specials = len(parts) - 1
        frequency: Counter[str] = Counter()
        for part in parts:
            if ODD.search(part):
                frequency.update(part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part))
            else:
                frequency.update(self.findall(part))
        pieces = self.pieces
        return specials + sum(n * pieces(pre_token) for pre_token, n in frequency.items())


def count_tokens(docs: DataFrame, tokenizer_path: str, max_known: int = 400_000, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs`` (``doc_id, text``).

    The counts equal those of the tokenizer file's library without begin, end or added tokens, truncation or padding. The
    file is read once, by the driver. NULL and empty texts have 0 bytes and tokens. Other columns are ignored; repeated
    rows are counted each; an empty table gives an empty one.
    """
    definition = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(definition.value, max_known)
        for batch in batches:
            texts = batch.column(1)
            tokens = pa.array([counter.count(text.as_py() or "") for text in texts], pa.int64())
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, tokens, pc.greater(tokens, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
