"""Edit-aware token counts with one tree per document.

The leaves of a tree are runs of whole pre-tokens, each about `leaf_chars` characters long, which
begin at a single space between two characters other than white space (the first at the start of
the text). Such a place is a pre-token boundary whatever stands further off, so token counts of
leaves add up. Inner nodes hold the sums of characters and tokens below them; a tree is a pair of
arrays in heap order and is stored with the document.

An edit replaces characters [start, stop) of the text it is stated against. Descending by character
sums finds the leaves it touches; one leaf that is not empty is taken on either side as context,
since an edit can join pre-tokens across the leaf's edge. That region alone is split and encoded
again, its pre-tokens are dealt to the same leaves, and the sums on the paths to the root follow.
Several edits of a document are stated against its original text, do not overlap, and are applied
from the last to the first, so that places stay valid.

Edge cases: NULL counts as empty; an empty text is one empty leaf. An edit beyond the end is cut to
the end. Edits that overlap raise ValueError. Rows that repeat a doc_id are edited alike. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpath.llm.common import small, text_of
from tillpath.llm.tokens import byte_level_units, rank_encoding, rank_ids

RANKS = "byte_bpe_multi_50k.tiktoken"
LEAF_CHARS = 256
EDITS = "array<struct<start:int,stop:int,replacement:string>>"


class Tree:
    """Sums of characters and tokens over the leaves of one text, in heap order."""

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.chars, self.tokens, self.half = chars, tokens, len(chars) // 2

    @classmethod
    def build(cls, text: str, count, leaf_chars: int = LEAF_CHARS) -> Tree:
        leaves, run, size = [], [], 0
        for unit in byte_level_units(text):
            run.append(unit)
            size += len(unit)
            if size >= leaf_chars:
                leaves.append("".join(run))
                run, size = [], 0
        if run or not leaves:
            leaves.append("".join(run))
        half = 1 << (len(leaves) - 1).bit_length()
        spare = [0] * (half - len(leaves))
        tree = cls([0] * half + [len(x) for x in leaves] + spare, [0] * half + [count(x) for x in leaves] + spare)
        for node in range(half - 1, 0, -1):
            tree._sum(node)
        return tree

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds character `place` (the last one with text, beyond the end) and where it starts."""
        node, start = 1, 0
        place = min(place, max(self.chars[1] - 1, 0))
        while node < self.half:
            node *= 2
            if place - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.half, start

    def edit(self, text: str, start: int, stop: int, replacement: str, count) -> tuple[str, int]:
        """The new text, and how many of its characters were encoded."""
        first, at = self.find(max(start - 1, 0))
        last, end = self.find(stop)
        end += self.chars[self.half + last]
        while first and (before := first - 1) >= 0:
            first = before
            at -= self.chars[self.half + first]
            if self.chars[self.half + first]:
                break
        while last + 1 < self.half:
            last += 1
            end += self.chars[self.half + last]
            if self.chars[self.half + last]:
                break
        region = text[at:start] + replacement + text[stop:end]
        units = byte_level_units(region)
        slots = last - first + 1
        share, filled = max(1, -(-len(region) // slots)), 0
        for slot in range(slots):
            run, size = [], 0
            while filled < len(units) and (size < share or slot == slots - 1):
                run.append(units[filled])
                size += len(units[filled])
                filled += 1
            leaf = "".join(run)
            node = self.half + first + slot
            self.chars[node], self.tokens[node] = len(leaf), count(leaf)
        low, high = (self.half + first) // 2, (self.half + last) // 2
        while low:
            for node in range(low, high + 1):
                self._sum(node)
            low, high = low // 2, high // 2
        return text[:start] + replacement + text[stop:], len(region)


def _counter(path: str):
    encoding = rank_encoding(path)
    return lambda text: len(rank_ids(encoding, text))


def build_trees(docs: DataFrame, path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, text, n_tokens and the tree (`tree_chars`, `tree_tokens`) of every row."""
    path = path or public_tokenizers.path(RANKS)

    def batches(stream):
        count = _counter(path)
        for batch in small(stream):
            trees = [Tree.build(t, count, leaf_chars) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([t.tokens[1] for t in trees], pa.int64()),
                    pa.array([t.chars for t in trees], pa.list_(pa.int32())),
                    pa.array([t.tokens for t in trees], pa.list_(pa.int32())),
                ],
                ["doc_id", "text", "n_tokens", "tree_chars", "tree_tokens"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return plain.mapInArrow(
        batches, "doc_id long, text string, n_tokens long, tree_chars array<int>, tree_tokens array<int>"
    )


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Adds `edits` to the trees from a table (doc_id, start, stop, replacement); none: an empty array.

    The edits of one document are applied one after the other and travel as one row with its text.
    """
    listed = edits.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "stop", "replacement"))).cast(EDITS).alias("edits")
    )
    return trees.join(listed, "doc_id", "left").withColumn(
        "edits", F.coalesce("edits", F.expr(f"cast(array() as {EDITS})"))
    )


def apply_edits(trees: DataFrame, path: str | None = None) -> DataFrame:
    """Applies `edits` to every tree: the columns of `build_trees` after them, with `n_tokens_before`,
    `n_edits` and `n_encoded_chars` (what had to be encoded again)."""
    path = path or public_tokenizers.path(RANKS)

    def batches(stream):
        count = _counter(path)
        for batch in small(stream):
            out = []
            for doc, text, before, chars, tokens, edits in zip(*[c.to_pylist() for c in batch.columns]):
                tree, touched = Tree(chars, tokens), 0
                size, upper = len(text), len(text)
                for edit in reversed(edits or []):
                    start, stop = min(edit["start"], size), min(edit["stop"], size)
                    if not 0 <= start <= stop <= upper:
                        raise ValueError(f"edits of document {doc} overlap or are out of order")
                    text, again = tree.edit(text, start, stop, edit["replacement"] or "", count)
                    touched += again
                    upper = start
                out.append((doc, text, tree.tokens[1], tree.chars, tree.tokens, before, len(edits or []), touched))
            columns = list(zip(*out)) or [[]] * 8
            kinds = [
                pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()),
                pa.int64(), pa.int64(), pa.int64(),
            ]
            names = ["doc_id", "text", "n_tokens", "tree_chars", "tree_tokens", "n_tokens_before", "n_edits", "n_encoded_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return trees.select("doc_id", "text", "n_tokens", "tree_chars", "tree_tokens", "edits").mapInArrow(
        batches,
        "doc_id long, text string, n_tokens long, tree_chars array<int>, tree_tokens array<int>,"
        " n_tokens_before long, n_edits long, n_encoded_chars long",
    )


def revision_of(text: str = "text") -> Column:
    """A stated revision of a text: seven characters from a third on go, two words come in after two
    thirds, and a line is added at the end."""
    size = F.char_length(text)
    third, two = F.floor(size / 3).cast("int"), F.floor(2 * size / 3).cast("int")

    def edit(start: Column, stop: Column, replacement: str) -> Column:
        return F.struct(start.alias("start"), stop.alias("stop"), F.lit(replacement).alias("replacement"))

    return F.array(
        edit(third, F.least(third + 7, two), ""), edit(two, two, "amended and"), edit(size, size, "\nEnd of the revision.")
    ).cast(EDITS)
