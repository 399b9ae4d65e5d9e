"""Spelling variants: words one edit apart, found in a trie over letter-group counts.

The alphabet is dealt to ``GROUPS`` groups. A word's path is the number of its letters in each group, and the trie has one level per group.
One edit moves the counts by at most one surplus (a group gains a letter) and one deficit (a group loses one), so a depth-first search
follows, level by level, the children whose count is the word's own, one more or one less, while that budget lasts. Words of the
leaves that it reaches are verified letter by letter. A leaf keeps each word by what is left when one of ``PIECES`` pieces is taken out, since one
edit leaves all pieces but one as they are, and gives out only words that agree on the rest.

The trie is cut into shards at nodes that hold at most ``SHARD`` words, deeper where more words lie. A word is sent to every shard whose
node its search can enter. A full path with more words than that is cut into blocks, and shards that many words ask are copied, so no task
holds more than a shard, whatever the words look like. Pairs are never written: a shard answers with the number of near words and the best.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import ne

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.base import partitions, stored
from waybill.operators.skew import skew_join

#: Letters in order of how frequent they are in European text; dealt to and fro, so that groups are about equally frequent.
FREQUENT = "eainrtosludcmpghbvfqyxjkzw"
GROUPS = 8
PIECES = 3
#: Words of a shard, and words that may ask a copy of it.
SHARD, ASKING = 50_000, 200_000
#: Levels at which a shard may be cut off.
DEPTHS = (2, 4, 6, GROUPS)
RUN = r"[a-zÀ-ÿ]+"


def word_counts(docs: DataFrame, length: int = 5, least: int = 3, thin: int | None = None) -> DataFrame:
    """word, n: the runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased) of at least ``length`` code points and ``least`` occurrences.

    With ``thin`` the letter h mod length is taken out of a run where ``thin`` divides h, the crc32 of ``<doc_id>:<run>``: a stand-in for typing
    errors. A null text has no words, a null doc_id reads as empty; repeated rows count as often as they stand.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate("text", upper, lower), F.lit(RUN), F.lit(0))).alias("word"),
    )
    if thin:
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        hashed = runs.select("word", F.crc32(F.concat("id", F.lit(":"), "word")).alias("h"))
        runs = hashed.select(F.when(F.col("h") % thin == 0, cut).otherwise(F.col("word")).alias("word"))
    return runs.where(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _dealt(groups: int) -> list[str]:
    """Letters of each group but the last, which has all others, too."""
    order = [*range(groups), *reversed(range(groups))]
    out = [""] * groups
    for i, letter in enumerate(FREQUENT):
        out[order[i % len(order)]] += letter
    return out


def path_of(word) -> F.Column:
    """Counts of a word's letters by group as text, "2,0,1,...": the node of the trie it lies in. Letters beyond a-z are dealt by their code point's last bits."""
    letters = _dealt(GROUPS)
    for code in range(0xC0, 0x100):
        letters[code % GROUPS] += chr(code)
    counts = [(F.length(word) - F.length(F.translate(word, chars, ""))).cast("string") for chars in letters]
    rest = F.length(F.translate(word, "".join(letters), "")).cast("string")
    return F.concat_ws(",", *counts, rest)


LEVELS = GROUPS + 1  # the last level counts characters of no group


def _beginning(path: str, depth: int) -> F.Column:
    return F.substring_index(path, ",", depth)


def _neighbours(counts: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
    """The nodes of one level that a search for ``counts`` may enter."""

    def walk(level: int, surplus: int, deficit: int, at: tuple[int, ...]):
        if level == len(counts):
            yield at
            return
        yield from walk(level + 1, surplus, deficit, (*at, counts[level]))
        if surplus:
            yield from walk(level + 1, surplus - 1, deficit, (*at, counts[level] + 1))
        if deficit and counts[level]:
            yield from walk(level + 1, surplus, deficit - 1, (*at, counts[level] - 1))

    return walk(0, 1, 1, ())


def _routes(depths: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                counts = tuple(map(int, path.split(",")))
                for depth in depths:
                    rows += [(path, ",".join(map(str, node))) for node in _neighbours(counts[:depth])]
            yield pd.DataFrame(rows, columns=["path", "node"])

    return run


def _pieces(length: int) -> list[tuple[int, int]]:
    """For a leaf's words of ``length`` letters: how many letters stand before a piece, and behind it.

    The pieces share out length - 1 letters. Whether the other word is a letter shorter, as long or a letter longer, there is a piece such that both words
    agree on that many first and last letters if they are one edit apart.
    """
    base = max(length - 1, 0)
    cuts = [k * base // PIECES for k in range(PIECES + 1)]
    return list(dict.fromkeys((a, base - b) for a, b in zip(cuts, cuts[1:], strict=False)))


class Trie:
    """Words of a shard below their paths. A leaf holds the pieces of its words and, for each word with one piece taken out, the words that give it."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, path: str, word: str, n: int) -> None:
        node = self.root
        *inner, last = path.split(",")
        for count in inner:
            node = node.setdefault(int(count), {})
        size = len(word)
        pieces, rests = node.setdefault(int(last), (_pieces(size), {}))
        for before, behind in pieces:
            rests.setdefault(word[:before] + word[size - behind :], []).append((word, n))

    def leaves(self, path: str) -> list[tuple[list[tuple[int, int]], dict]]:
        """Leaves within a surplus and a deficit of one."""
        counts, out = tuple(map(int, path.split(","))), []

        def walk(node, level: int, surplus: int, deficit: int) -> None:
            if level == len(counts):
                out.append(node)
                return
            own = counts[level]
            if own in node:
                walk(node[own], level + 1, surplus, deficit)
            if surplus and own + 1 in node:
                walk(node[own + 1], level + 1, 0, deficit)
            if deficit and own - 1 in node:
                walk(node[own - 1], level + 1, surplus, 0)

        walk(self.root, 0, 1, 1)
        return out


def one_edit(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :]


def near_words(leaves: list[tuple[list[tuple[int, int]], dict]], word: str) -> dict[str, int]:
    """The verified words of the leaves and their n."""
    size, near = len(word), {}
    for pieces, rests in leaves:
        for before, behind in pieces:
            for other, n in rests.get(word[:before] + word[size - behind :], ()):
                if other not in near and one_edit(word, other):
                    near[other] = n
    return near


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by shard and copy, its words first, then those that ask, by path; holds one shard and the leaves of one path."""
    shard = asked = trie = leaves = None
    for batch in batches:
        out = []
        for node, block, copy, asks, path, word, n in batch[["node", "block", "copy", "asks", "path", "word", "n"]].itertuples(index=False):
            if (node, block, copy) != shard:
                shard, asked, trie = (node, block, copy), None, Trie()
            if not asks:
                trie.add(path, word, n)
                continue
            if path != asked:
                asked, leaves = path, trie.leaves(path)
            near = near_words(leaves, word)
            if near:
                most = max(near.values())
                out.append((word, len(near), most, min(w for w, n in near.items() if n == most)))
        yield pd.DataFrame(out, columns=["word", "n_near", "form_n", "form"])


def _shards(paths: DataFrame, shard: int) -> DataFrame:
    """path -> node: the highest node of the path with at most ``shard`` words, the full path if none; blocks of that node."""
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _beginning("path", d).alias("node")) for d in (*DEPTHS, LEVELS)])).alias("a")
    steps = paths.select("path", "n", at).select("path", "n", "a.depth", "a.node")
    sizes = stored(steps.groupBy("node").agg(F.sum("n").alias("size"), F.first("depth").alias("depth")), "spelling-nodes")
    fitting = sizes.where((F.col("size") <= shard) | (F.col("depth") == LEVELS))
    return (
        steps.select("path", "node")
        .join(fitting, "node")
        .groupBy("path")
        .agg(F.min_by(F.struct("node", "depth", F.ceil(F.col("size") / shard).cast("int").alias("blocks")), "depth").alias("s"))
        .select("path", "s.*")
    )


def near_counts(words: DataFrame, shard: int = SHARD, asking: int = ASKING) -> DataFrame:
    """word, n_near, form_n, form for each word with a near word: how many, the largest n and the smallest word that has it; words: word, n, each once."""
    placed = stored(words.select("word", "n", path_of(F.col("word")).alias("path")), "spelling-words")
    paths = stored(placed.groupBy("path").agg(F.count(F.lit(1)).alias("n")), "spelling-paths")
    homes = stored(_shards(paths, shard), "spelling-shards")
    shards = homes.groupBy("node").agg(F.first("blocks").alias("blocks"), F.first("depth").alias("depth"))
    depths = sorted(r["depth"] for r in shards.select("depth").distinct().collect())  # five at most
    routes = paths.select("path").mapInPandas(_routes(depths), "path string, node string").join(shards.select("node", "blocks"), "node")
    routes = stored(routes, "spelling-routes")
    asked = routes.join(paths, "path").groupBy("node").agg(F.ceil(F.sum("n") / asking).cast("int").alias("copies"))
    asked = stored(asked, "spelling-copies")
    h, part = F.xxhash64("word"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    held = (
        placed.join(homes.select("path", "node", "blocks"), "path")
        .join(asked.withColumnRenamed("copies", "parts"), "node")
        .select("node", F.pmod(h, F.col("blocks")).cast("int").alias("block"), part.alias("copy"), F.lit(0).alias("asks"), "path", "word", "n")
    )
    asks = (
        placed.join(routes.withColumnRenamed("blocks", "parts"), "path")
        .join(asked, "node")
        .select("node", part.alias("block"), F.pmod(h, F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("asks"), "path", "word", "n")
    )
    rows = paths.agg(F.sum("n")).first()[0] or 0
    order = ["node", "block", "copy", "asks", "path", "word"]
    answers = (
        held.unionByName(asks)
        .repartition(partitions(words, rows, shard), "node", "block", "copy")
        .sortWithinPartitions(*order)
        .mapInPandas(_search, "word string, n_near long, form_n long, form string")
    )
    best = F.min_by(F.struct("form_n", "form"), F.struct(-F.col("form_n"), "form"))
    return answers.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.*")


def _roots(links: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms. Each form is at least twice as frequent, so a chain has no circle and 63 links at most; a round doubles the reach."""
    reached = stored(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(skew_join(reached, ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "spelling-roots")
        reached = longer.select("word", "root")
        if longer.where("went").isEmpty():
            return reached


def variants(words: DataFrame, ratio: int = 2, shard: int = SHARD, asking: int = ASKING) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word.

    words: word, n, each word once; other columns play no part. Two words are near if one inserted, deleted or replaced code point
    makes one the other. A word's form is its near word of largest n, the smallest in code-point order among equals, if that n is at least ``ratio`` (2 or more)
    times the word's own; else null. The root ends the chain of forms, the word itself if it has none. Rows whose word or n is null are left
    out; an empty table gives none. Words may be of any length, the empty one included.
    """
    words = stored(words.where("word IS NOT NULL AND n IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "spelling-vocabulary")
    near = near_counts(words, shard, asking)
    enough = F.col("form_n") >= F.lit(ratio) * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", F.when(enough, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("form_n")).alias("form_n")
    )
    found = stored(found, "spelling-forms")
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
