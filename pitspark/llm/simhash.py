"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints are compared exactly: distinct fingerprints are ordered by population count, cut into tiles of bounded
size, and every pair of tiles whose population counts can be within the radius is compared with numpy exclusive-or and
bit counts. Each tile pair sends on only a spanning forest of its links, so a large group of near copies costs rows in
proportion to its members, not to its pairs.

The pipeline's stage takes such pairs as candidates only: a link needs the demanded similarity of the two texts' sets
of shingles, which are read from stored texts when a comparison meets a candidate.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, filesystem, row_key
from .components import connected_components

SEED = 42
_CHUNK = 1 << 16
_CELLS = 1 << 18
#: Comparisons of tiles are cut into slices until there are about so many.
TASKS = 512
#: A comparison keeps the shingle sets of its candidates until they hold so many shingles, and so many files open.
KEPT_SHINGLES, KEPT_FILES = 1 << 22, 64
#: The bitmap that spares most kept rows the join with the rows that go has so many bits (4 MB, whatever the table's size).
BITMAP_BITS = 1 << 25


def simhash(text: str | None, shingle: int = 4, words: int = 1) -> bytes:
    """Fingerprint of 64 * words bits, most significant bit first.

    A-Z are lower-cased, words are runs of characters other than ASCII white space, shingles are `shingle` words joined
    by one space with repeats counted; a shorter text is one shingle, a text without words (or null) is all zero bits.
    A bit is set if it is set in over half of the shingles' hashes: XXH64 (seed 42) for the first 64 bits, mixes of it
    for further ones. Long texts are worked through in chunks.
    """
    joined = _joined(text)
    return _print_of(_hashes(joined, shingle), words) if joined else bytes(8 * words)


def _print_of(hashes: Iterable[np.ndarray], words: int) -> bytes:
    """The fingerprint of shingles given by their hashes (big-endian) in chunks."""
    ones, n = np.zeros(64 * words, np.int64), 0
    for base in hashes:
        n += len(base)
        for w in range(words):
            part = base if not w else _mixed(base.astype(np.uint64), w).astype(">u8")
            ones[64 * w : 64 * w + 64] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > n).tobytes()


def _joined(text: str | None) -> bytes:
    """The text's words, lower-cased, with one space between them."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) if text else b""


def _hashes(joined: bytes, shingle: int) -> Iterator[np.ndarray]:
    """The hashes (big-endian) of the shingles of words joined by one space, in chunks."""
    cuts = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(joined)]))
    k = min(shingle, len(starts))
    n = len(starts) - k + 1
    digest = xxhash.xxh64_digest
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        raw = b"".join([digest(joined[i:j], SEED) for i, j in zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist())])
        yield np.frombuffer(raw, ">u8")


def shingle_set(joined: bytes, shingle: int) -> np.ndarray:
    """The distinct shingles of joined words, as their sorted 64-bit hashes."""
    return np.unique(np.concatenate([h.astype(np.uint64) for h in _hashes(joined, shingle)])) if joined else np.empty(0, np.uint64)


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets (of empty ones: 1)."""
    union = len(np.union1d(a, b))
    return (len(a) + len(b) - union) / union if union else 1.0


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """An independent 64-bit hash from h (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint_column(shingle: int, words: int):
    @F.pandas_udf("binary")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, shingle, words) for t in texts], index=texts.index, dtype=object)

    return fingerprint


def stored_column(folder: str, shingle: int, words: int):
    """Fingerprint, key and size of the shingle set of each text; its words go to a file of the task in `folder`, at the place named.

    The fingerprint is over distinct shingles, so that a line repeated in a text weighs no more in it than in the similarity.
    """

    @F.pandas_udf("fp binary, text_key binary, shingles int, file string, at long, bytes int")
    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name, at = uuid.uuid4().hex, 0  # of this attempt: a repeated task has a file of its own
        with fs.open_output_stream(f"{root}/{name}") as out:
            for texts in batches:
                rows = []
                for text in texts:
                    joined = _joined(text)
                    distinct = shingle_set(joined, shingle)
                    chunks = (distinct[i : i + _CHUNK].astype(">u8") for i in range(0, len(distinct), _CHUNK))
                    packed = zlib.compress(joined, 1)
                    out.write(packed)
                    rows.append((_print_of(chunks, words), hashlib.sha256(joined).digest(), len(distinct), name, at, len(packed)))
                    at += len(packed)
                yield pd.DataFrame(rows, columns=["fp", "text_key", "shingles", "file", "at", "bytes"])

    return stored.asNondeterministic()  # so that no plan runs it twice


class StoredSets:
    """Shingle sets of the rows of a comparison (columns node, shingles, file, at, bytes), read when asked for."""

    def __init__(self, folder: str, shingle: int, similarity: float, pdf: pd.DataFrame):
        self.fs, self.root = filesystem(folder)
        self.shingle, self.similarity = shingle, similarity
        self.node, self.n = pdf["node"].to_numpy(), pdf["shingles"].to_numpy()
        self.place = [pdf[c].to_numpy() for c in ("file", "at", "bytes")]
        self.sets: dict[int, np.ndarray] = {}
        self.files: dict[str, object] = {}
        self.held = 0

    def __getitem__(self, row: int) -> np.ndarray:
        got = self.sets.get(row)
        if got is None:
            name, at, size = (column[row] for column in self.place)
            if name not in self.files:
                while len(self.files) >= KEPT_FILES:
                    self.files.pop(next(iter(self.files))).close()
                self.files[name] = self.fs.open_input_file(f"{self.root}/{name}")
            self.files[name].seek(int(at))
            got = shingle_set(zlib.decompress(self.files[name].read(int(size))), self.shingle)
            while self.sets and self.held + len(got) > KEPT_SHINGLES:
                self.held -= len(self.sets.pop(next(iter(self.sets))))
            self.sets[row] = got
            self.held += len(got)
        return got

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs of rows have the similarity. The sizes alone rule out most that have not."""
        small, large = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
        out = self.node[a] == self.node[b]
        for i in np.flatnonzero(~out & (small / np.maximum(large, 1) >= self.similarity)):
            out[i] = similarity_of(self[a[i]], self[b[i]]) >= self.similarity
        return out

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def find(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = label[x]
        if np.array_equal(up, x):
            return x
        x = up


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the sets of a[i] and b[i] in the parent array `label`, smaller index first."""
    while len(a):
        ra, rb = find(label, a), find(label, b)
        differ = ra != rb
        if not differ.any():
            return
        a, b = np.minimum(ra, rb)[differ], np.maximum(ra, rb)[differ]
        label[b] = a  # one writer wins for each b; the others are tried again


def unite_similar(label: np.ndarray, a: np.ndarray, b: np.ndarray, similar: Callable) -> None:
    """As unite, for those of the pairs that similar(a, b) confirms. Pairs whose ends are in one set by then are not asked for.

    Of the pairs between the same two sets a few are asked for at a time, in each round four times as many.
    """
    share = 1
    while True:
        ra, rb = find(label, a), find(label, b)
        differ = ra != rb
        a, b = a[differ], b[differ]
        if not len(a):
            return
        key = np.minimum(ra, rb)[differ] * len(label) + np.maximum(ra, rb)[differ]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.concatenate((first, [len(a)]))))
        now, later = order[rank < share], order[rank >= share]
        ok = similar(a[now], b[now])
        unite(label, a[now][ok], b[now][ok])
        a, b = a[later], b[later]
        share *= 4


class _Buffers:
    """Working arrays that all chunks share, so that no chunk asks the system for fresh pages."""

    def __init__(self):
        self.x, self.n, self.m, self.hit = np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0, np.uint8), np.empty(0, bool)

    def of(self, rows: int, cols: int) -> tuple[np.ndarray, ...]:
        if len(self.x) < rows * cols:
            self.x, self.n, self.m, self.hit = (np.empty(rows * cols, a.dtype) for a in (self.x, self.n, self.m, self.hit))
        return tuple(a[: rows * cols].reshape(rows, cols) for a in (self.x, self.n, self.m, self.hit))


def _close(mine: np.ndarray, theirs: np.ndarray, radius: int, buffers: _Buffers) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within the radius. Two words decide most pairs of wide fingerprints (three if the radius
    is near what two words of unrelated texts differ by); the others are compared for what is left.

    theirs: one contiguous row per word.
    """
    x, n, m, hit = buffers.of(len(mine), theirs.shape[1])
    np.bitwise_count(np.bitwise_xor(mine[:, 0][:, None], theirs[0][None, :], out=x), out=n)
    first = min(len(theirs), 2 if radius <= 44 else 3)
    for w in range(1, first):
        np.bitwise_count(np.bitwise_xor(mine[:, w][:, None], theirs[w][None, :], out=x), out=m)
        np.add(n, m, out=n)  # at most 192: fits
    flat = np.flatnonzero(np.less_equal(n, radius, out=hit))
    i, j = flat // theirs.shape[1], flat % theirs.shape[1]
    if len(theirs) > first and len(i):
        total = np.bitwise_count(mine[i] ^ theirs[:, j].T).sum(axis=1, dtype=np.int32)
        i, j = i[total <= radius], j[total <= radius]
    return i, j


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int, similar: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) positions in left followed by right: a spanning forest of all links between two tiles (or within one).

    left, right: (n, words) uint64. Rows of a population count are compared only with rows whose count is within the radius.
    With similar(a, b), which tells of pairs of positions whether they are similar, only similar pairs are links.
    """
    both = left if right is None else np.concatenate((left, right))
    pop = np.bitwise_count(both).sum(axis=1, dtype=np.int32)
    label = np.arange(len(both))
    rows = np.argsort(pop[: len(left)], kind="stable")
    cols = rows if right is None else len(left) + np.argsort(pop[len(left) :], kind="stable")
    col_pop, row_pop = pop[cols], pop[rows]
    by_word, buffers = np.ascontiguousarray(both[cols].T), _Buffers()
    at = 0
    while at < len(rows):
        p = row_pop[at]
        lo = at if right is None else np.searchsorted(col_pop, p - radius, "left")
        hi = np.searchsorted(col_pop, p + radius, "right")
        end = min(np.searchsorted(row_pop, p, "right"), at + max(1, _CELLS // max(1, hi - lo)))
        mine, theirs = rows[at:end], cols[lo:hi]
        if hi > lo:
            i, j = _close(both[rows[at:end]], by_word[:, lo:hi], radius, buffers)
            x, y = rows[at:end][i], cols[lo:hi][j]
            other = x != y if right is not None else i < j  # within a tile lo is at
            if similar is None:
                unite(label, x[other], y[other])
            else:
                unite_similar(label, x[other], y[other], similar)
        at = end
    root = find(label, label.copy())
    member = np.flatnonzero(root != np.arange(len(both)))
    return member, root[member]


def tiles_of(histogram: dict[int, int], tile_rows: int, radius: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Tiles (lowest count, highest count, parts) over a population-count histogram, and for each of them
    (its first tile, parts, first partner, last partner). Tiles are numbered in order of population count.

    A tile spans a quarter of the radius, so its partners are nine spans whatever the table's size; a span of over
    tile_rows rows is cut into parts.
    """
    width = max(1, radius // 4)
    spans: dict[int, int] = {}
    for p, n in histogram.items():
        spans[p // width] = spans.get(p // width, 0) + n
    tiles, base, at = [], [], 0
    for k in sorted(spans):
        tiles.append((k * width, k * width + width - 1, -(-spans[k] // tile_rows)))
        base.append(at)
        at += tiles[-1][2]
    out = []
    for k, (lo, hi, parts) in enumerate(tiles):
        near = [i for i, (a, b, _) in enumerate(tiles) if a - hi <= radius and lo - b <= radius]
        out.append((base[k], parts, base[near[0]], base[near[-1]] + tiles[near[-1]][2] - 1))
    return tiles, out


def near_duplicate_nodes(prints: DataFrame, radius: int, words: int, s: Scratch, tile_rows: int = 131072, stored: tuple[str, int, float] | None = None) -> DataFrame:
    """(node, root) for the nodes of `prints` (node long, fp binary) that have a link within the radius.

    With stored = (folder, shingle, similarity) a link also needs that similarity of the shingle sets; prints then has the
    columns of stored_column too. What the driver sees is a histogram over population counts: at most 64 * words + 1 rows.
    """
    spark = prints.sparkSession
    pop = sum((F.expr(f"bit_count(cast(conv(hex(substring(fp, {8 * w + 1}, 8)), 16, -10) as bigint))") for w in range(words)), F.lit(0)).cast("int")
    carried = ["node", "fp", *(["shingles", "file", "at", "bytes"] if stored else [])]
    counted = s.write(prints.select(*carried, pop.alias("pop")), "pop")
    histogram = {r["pop"]: r["n"] for r in counted.groupBy("pop").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not histogram:
        return spark.createDataFrame([], "node long, root long")
    tiles, spans = tiles_of(histogram, tile_rows, radius)
    span = F.lit(None).cast("struct<base:int,parts:int,first:int,last:int>")
    for (_, hi, _), (base, parts, first, last) in reversed(list(zip(tiles, spans))):
        here = F.struct(F.lit(base).alias("base"), F.lit(parts).alias("parts"), F.lit(first).alias("first"), F.lit(last).alias("last"))
        span = F.when(F.col("pop") <= hi, here).otherwise(span)
    placed = counted.withColumn("span", span).select(*carried, (F.col("span.base") + F.pmod(F.xxhash64("fp"), F.col("span.parts"))).cast("int").alias("tile"), "span.first", "span.last")
    pairs = sum(parts * (last - first + 1) for _, parts, first, last in spans)
    slices = max(1, min(8, TASKS // max(1, pairs)))
    mine = F.pmod(F.xxhash64(F.lit(SEED), "fp"), F.lit(slices)).cast("int")
    meet = placed.select(*carried, "tile", mine.alias("mine"), F.explode(F.sequence("first", "last")).alias("other"))
    # Rows of the lower tile go to one slice, those of the upper to all; within a tile every slice meets all rows.
    where = F.when(F.col("tile") < F.col("other"), F.array("mine")).otherwise(F.sequence(F.lit(0), F.lit(slices - 1)))
    dealt = meet.select(*carried, F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), (F.col("tile") <= F.col("other")).alias("low"), "mine", F.explode(where).alias("slice"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["a"].iat[0] == pdf["b"].iat[0]
        left = pdf["low"].to_numpy(bool) & (pdf["mine"].to_numpy() == pdf["slice"].iat[0])
        right = np.full(len(left), True) if same else ~left
        nodes = pdf["node"].to_numpy()
        bits = np.frombuffer(b"".join(pdf["fp"]), ">u8").astype(np.uint64).reshape(-1, words)
        sets = StoredSets(*stored, pdf) if stored else None
        similar = (lambda a, b: sets.similar(order[a], order[b])) if stored else None
        if same and left.all():
            order = np.arange(len(left))
            member, root = tile_links(bits, None, radius, similar)
        elif left.any() and right.any():
            order = np.concatenate((np.flatnonzero(left), np.flatnonzero(right)))
            member, root = tile_links(bits[left], bits[right], radius, similar)
        else:
            return pd.DataFrame({"u": [], "v": []}).astype("int64")
        if sets:
            sets.close()
        u, v = nodes[order[member]], nodes[order[root]]
        return pd.DataFrame({"u": u[u != v], "v": v[u != v]})

    tasks = max(16, min(slices * pairs, 2000 + slices * pairs // 16))  # by number, as the little data of a task says nothing of its work
    links = dealt.repartition(tasks, "a", "b", "slice").groupBy("a", "b", "slice").applyInPandas(compare, "u long, v long")
    return connected_components(links, s)


def _components(prints: DataFrame, key: str, radius: int, words: int, tile_rows: int, s: Scratch, stored: tuple[str, int, float] | None = None, keep: bool = False) -> DataFrame:
    """(key, component_id) for every row of prints (node, key, fp, least_doc)."""
    roots = s.write(near_duplicate_nodes(prints, radius, words, s, tile_rows, stored), "roots")
    least = s.write(roots.join(prints.select("node", "least_doc"), "node").groupBy("root").agg(F.min("least_doc").alias("component_id")), "least")
    classes = prints.join(roots.join(least, "root").select("node", "component_id"), "node", "left")
    return s.write(classes.select(key, F.coalesce("component_id", "least_doc").alias("component_id")), "classes", keep)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, words: int = 1, tile_rows: int = 131072) -> DataFrame:
    """One row per row of docs: row_id, doc_id, fp (binary) and component_id, the smallest id linked to it by any chain of links.

    Null and wordless texts share the zero fingerprint and so are linked. A null id takes part, but is never the
    smallest; if a component has only null ids, component_id is null. Repeated rows give one output row each; other
    columns are dropped, so clashing names do no harm. An empty table gives an empty result.
    """
    fp = fingerprint_column(shingle, words)
    with Scratch(docs.sparkSession, "simhash") as s:
        rows = s.write(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), fp(F.col(text_col)).alias("fp")), "rows", keep=True)
        prints = s.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least_doc")).select(F.monotonically_increasing_id().alias("node"), "fp", "least_doc"), "prints")
        classes = _components(prints, "fp", radius, words, tile_rows, s, keep=True)
    return rows.join(classes, "fp").select("row_id", "doc_id", "fp", "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 72, words: int = 4, tile_rows: int = 131072, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each group the row with the smallest id stays (null ids last, then by a hash of the text).

    A link of a group is a pair of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    Candidates are pairs of 256-bit fingerprints within the radius: the angle between two texts' shingles has a cosine of
    about 2J/(1+J), so J = 0.8 lies at 39 bits on average with a standard deviation under 6 (at 48 for texts of four and five
    shingles, the worst), unrelated texts at 128 +- 8. A text with fewer words than a shingle is one shingle; texts without words
    are copies of each other. Of rows equal in id and text one stays, whichever. All columns are kept. The texts are not
    written again but as words for the comparison, and those go before this returns: the result is docs without the rows that go,
    of which only those that a bitmap of the latter's keys cannot clear meet them in a join.
    """
    text = F.col(f"`{text_col}`")
    key = row_key(id_col, text_col)
    with Scratch(docs.sparkSession, "near-dedup") as s:
        folder = s.path("texts")
        rows = s.write(docs.select(*key, F.col(f"`{id_col}`").cast("long").alias("doc_id"), stored_column(folder, shingle, words)(text).alias("f")), "rows")
        place = F.min(F.struct("f.file", "f.at", "f.bytes")).alias("place")
        texts = rows.groupBy("f.text_key", "f.fp", "f.shingles").agg(F.min("doc_id").alias("least_doc"), place)
        prints = s.write(texts.select(F.monotonically_increasing_id().alias("node"), "text_key", "fp", "shingles", "least_doc", "place.*"), "prints")
        classes = _components(prints, "text_key", radius, words, tile_rows, s, (folder, shingle, similarity))
        keys = rows.groupBy("k1", "k2", "doc_id", "f.text_key").agg(F.count(F.lit(1)).alias("n")).join(classes, "text_key")
        group = F.coalesce(F.col("component_id").cast("string"), F.hex("text_key")).alias("grp")
        keys = s.write(keys.select("k1", "k2", "n", group, F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2").alias("ord")), "keys")
        best = s.write(keys.groupBy("grp").agg(F.min("ord").alias("best")), "best")
        fate = s.write(keys.join(best, "grp").select("k1", "k2", "n", F.col("ord").eqNullSafe(F.col("best")).alias("stays")), "fate")
        gone = s.write(fate.where("not stays or n > 1").select("k1", "k2"), "gone", keep=True)
        twice = s.write(fate.where("stays and n > 1").select("k1", "k2"), "twice", keep=True)
    keyed = docs.select(*key, F.struct("*").alias("row"))
    listed = maybe_among(gone, "k1")(F.col("k1"))
    doubtful = keyed.where(listed)
    kept = keyed.where(~listed).select("row").union(doubtful.join(gone, ["k1", "k2"], "left_anti").select("row"))
    if not twice.isEmpty():
        kept = kept.union(doubtful.join(twice, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row"))
    return kept.select("row.*")


def maybe_among(keys: DataFrame, column: str, bits: int = BITMAP_BITS):
    """A test of a long column: false only where no row of keys has that value.

    It is a bitmap over the values' last bits, put together by word in Spark; the driver sees bits / 64 rows at most. Of a
    table so large that most bits are set it says true for most rows, which a join then decides as it does the others.
    """
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("bit")).groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toPandas()
    bitmap = np.zeros(bits >> 6, np.int64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)

    @F.pandas_udf("boolean")
    def listed(values: pd.Series) -> pd.Series:
        v = values.to_numpy(np.int64)
        return pd.Series((bitmap[(v & (bits - 1)) >> 6] >> (v & 63)) & 1 == 1, index=values.index)

    return listed
