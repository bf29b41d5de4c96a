"""N-gram Jaccard join by a token-group matrix, exact at every size.

1. Each document becomes its set of word shingles; equal sets fold into one class.
2. Similar sets form groups: sets that share a min-hash meet the smallest id of that
   min-hash, and a verified link joins its group.
3. Token-group matrix, on signatures: for each shingle of a signature the groups whose
   union holds it. The signature of a set of n shingles is the n - ceil(t n) + k
   smallest hashes; two sets over the threshold t share at least k' = k(ceil(t n)) of
   them. A document whose signature meets other groups in fewer than k' shingles is
   done: its overlap bound fails for every group.
4. Token-group matrix, on whole sets of the rest: cells (shingle, group) are the token
   unions. A shingle that no other group holds cannot be shared, so the r others bound
   the overlap with any group; two sets of n and m shingles need t (n + m) / (1 + t).
   Documents whose bound fails go, twice over. In order of rising document frequency
   one of the first r - ceil(t n) + 1 shingles must be shared: these name the groups
   whose overlap is worth counting. The overlap of a query with a group's token union
   is then counted exactly, over all its shingles, and only groups whose count reaches
   the bound of their smallest fitting set are opened.
5. Groups that open each other make a family. A family's sets are cut into blocks of
   about ``BLOCK`` shingles and each two blocks meet once: the overlaps of all their
   sets are counted at once. That verifies, counts every link between different texts
   and leaves one edge a set and block pair, which components take.

Groups are counted, not their members, so thousands of near copies cost one entry a
shingle. No table of document pairs exists but that of sets and their group's smallest
id; a set travels once per block of its family, with its hashes and not its text.
Nothing is capped or sampled. Counting the links of a family takes work in the square
of its blocks. A document's links are the other documents at the threshold, with those
of equal sets. Building the plan runs jobs: intermediate tables are written on the way.

Defined results: null and blank texts have an empty set and link with nothing; texts
below the shingle width are one shingle; a null doc_id links with nothing and has a
null component; rows that repeat a doc_id are one node, and where their texts differ
the one whose hash is smallest stands for it; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets, discard, keep, released, table
from .components import components
from .vec import chunks, mix, runs, word_arrays

WIDTH, PERCENT = 3, 90
SEEDS = np.array([0, 0x51ED270B35AC8F17, 0x2C8A19F4D3B7E605], np.uint64)
CHUNK = 1 << 21
BLOCK, BLOCK_SETS = 1 << 18, 1 << 11
HUB = 256


def shingle_sets(texts: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text in ascending order, first of each text with the end last)."""
    h, first, *_ = word_arrays(texts, lower=True)
    n = np.diff(first)
    parts, rows = [], []
    s = runs(h, width)
    if len(s):
        row = np.repeat(np.arange(len(texts)), n)[: len(s)]
        ok = np.arange(width, len(h) + 1) <= first[row + 1]
        parts.append(s[ok])
        rows.append(row[ok])
    for k in range(1, width):  # too short for a shingle: the whole sequence
        short = np.flatnonzero(n == k)
        if len(short):
            parts.append(runs(h, k)[first[short]])
            rows.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    s, row = np.concatenate(parts), np.concatenate(rows)
    o = np.lexsort((s, row))
    s, row = s[o], row[o]
    new = np.append(True, (s[1:] != s[:-1]) | (row[1:] != row[:-1]))
    s, row = s[new], row[new]
    return s, np.searchsorted(row, np.arange(len(texts) + 1))


def need(n, percent: int):
    """ceil(percent n / 100): the least overlap of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def spare(n):
    """k(n) = ceil(n / 10): signature shingles beyond the plain prefix."""
    return -(-n // 10)


def _signatures(width: int, percent: int):
    def run(batches):
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["doc_id"]
            for a, b in chunks(texts, CHUNK):
                s, at = shingle_sets(texts[a:b], width)
                n = np.diff(at)
                out = pd.DataFrame({"doc_id": ids.iloc[a:b].to_numpy(), "th": pdf["th"].iloc[a:b].to_numpy(), "n": n})
                sums = []
                for k in (0x9E6C63D0876A9A99, 0xC3A5C85C97CB3127):
                    c = np.zeros(len(s) + 1, np.uint64)
                    np.cumsum(mix(s * np.uint64(k)), out=c[1:])
                    sums.append((c[at[1:]] - c[at[:-1]]).view(np.int64))
                out["s1"], out["s2"] = sums
                full = np.flatnonzero(n)
                low = np.zeros((len(n), len(SEEDS)), np.uint64)
                for i, seed in enumerate(SEEDS):
                    if len(full):
                        low[full, i] = np.minimum.reduceat(s if i == 0 else mix(s ^ seed), at[full])
                out["low"] = list(low.view(np.int64))
                size = np.minimum(n, n - need(n, percent) + spare(n))
                signed = s.view(np.int64)
                out["sig"] = [signed[x : x + m] for x, m in zip(at[:-1], size, strict=True)]
                yield out

    return run


def _verify(width: int, percent: int):
    def run(batches):
        for pdf in batches:
            got = np.zeros(len(pdf), bool)
            ta, tb = pdf["ta"].tolist(), pdf["tb"].tolist()
            for x, y in chunks([p + q for p, q in zip(ta, tb, strict=True)], CHUNK):
                sa, fa = shingle_sets(ta[x:y], width)
                sb, fb = shingle_sets(tb[x:y], width)
                for i in range(y - x):
                    p, q = sa[fa[i] : fa[i + 1]], sb[fb[i] : fb[i + 1]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    got[x + i] = both > 0 and 100 * both >= percent * (len(p) + len(q) - both)
            yield pdf.loc[got, ["a", "b"]]

    return run


def _whole_sets(width: int):
    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in chunks(texts, CHUNK):
                s, at = shingle_sets(texts[a:b], width)
                out = pdf.iloc[a:b].drop(columns="text")
                signed = s.view(np.int64)
                out["hs"] = [signed[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                yield out

    return run


def _met_elsewhere(sets: DataFrame, percent: int) -> DataFrame:
    """sets(id, n, g, hs) with hs cut to shingles that another group holds too, rarest first; sets that keep too few go."""
    cell = sets.select("id", "n", "g", F.explode("hs").alias("h"))
    df = cell.groupBy("h").agg(F.count("*").alias("df"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("h", "df")
    met = cell.join(df, "h").groupBy("id", "n", "g").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("x"))
    return met.where(100 * F.size("x") >= percent * F.col("n")).select("id", "n", "g", F.transform("x", lambda x: x["h"]).alias("hs"))


def overlaps(sets: list, others: list) -> np.ndarray:
    """Sizes of the overlaps of each set with each of the others (arrays without repeats)."""
    own, far = np.concatenate(sets), np.concatenate(others)
    ra, rb = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.repeat(np.arange(len(others)), [len(x) for x in others])
    ids, inv = np.unique(np.concatenate([own, far]), return_inverse=True)
    ia, ib = inv[: len(own)], inv[len(own) :]
    ca, cb = np.bincount(ia, minlength=len(ids)), np.bincount(ib, minlength=len(ids))
    # shingles of every set count for every pair; those of one side only for none
    everywhere = (ca == len(sets)) & (cb == len(others))
    out = np.full((len(sets), len(others)), int(everywhere.sum()), np.int64)
    use = (ca > 0) & (cb > 0) & ~everywhere
    column = np.cumsum(use) - 1
    ka, kb = use[ia], use[ib]
    ra, ia, rb, ib = ra[ka], column[ia[ka]], rb[kb], column[ib[kb]]
    oa, ob = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
    ra, ia, rb, ib = ra[oa], ia[oa], rb[ob], ib[ob]
    width = max(1, (1 << 22) // max(len(sets), len(others)))
    for x in range(0, int(use.sum()), width):
        a, b = (slice(*np.searchsorted(i, [x, x + width])) for i in (ia, ib))
        p, q = np.zeros((len(sets), width), np.float32), np.zeros((len(others), width), np.float32)
        p[ra[a], ia[a] - x] = 1
        q[rb[b], ib[b] - x] = 1
        out += (p @ q.T).astype(np.int64)
    return out


def roots(got: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows and columns the smallest id that they reach over the links of this matrix; their own where they have none."""
    ra, rb = a.copy(), b.copy()
    i, j = np.nonzero(got)
    while True:
        na, nb = ra.copy(), rb.copy()
        np.minimum.at(na, i, rb[j])
        np.minimum.at(nb, j, na[i])
        if (na == ra).all() and (nb == rb).all():
            return ra, rb
        ra, rb = na, nb


def _compare(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, cell in pdf.groupby("g", sort=False):
            i, j = int(cell["i"].iloc[0]), int(cell["j"].iloc[0])
            a, b = (cell[cell["block"] == x] for x in (i, j))
            if not len(a) or not len(b) or (i == j and len(a) == 1):
                continue
            n, m = a["n"].to_numpy(np.int64)[:, None], b["n"].to_numpy(np.int64)[None, :]
            both = overlaps(a["hs"].tolist(), b["hs"].tolist())
            got = (both > 0) & (100 * both >= percent * (n + m - both))
            if i == j:
                np.fill_diagonal(got, False)
            ia, ib = a["id"].to_numpy(np.int64), b["id"].to_numpy(np.int64)
            ra, rb = roots(got, ia, ib)
            out.append(pd.DataFrame({"id": ia, "links": got @ b["copies"].to_numpy(np.int64), "root": ra}))
            if i != j:
                out.append(pd.DataFrame({"id": ib, "links": got.T @ a["copies"].to_numpy(np.int64), "root": rb}))
        out = pd.concat(out) if out else pd.DataFrame({x: np.zeros(0, np.int64) for x in ("id", "links", "root")})
        return out[out["links"] > 0]

    return run


def compared(members: DataFrame, texts: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """members(id, th, n, g, copies) of families g -> id, links (documents of other sets it links with), root (a smaller id that it reaches, or itself); a row per set and block pair."""
    size = members.groupBy("g").agg(F.sum("n").alias("all"), F.count("*").alias("c")).where("c > 1")
    size = size.select("g", F.xxhash64("g").alias("k"), F.greatest(F.ceil(F.col("all") / BLOCK), F.ceil(F.col("c") / BLOCK_SETS)).alias("blocks"))
    m = members.withColumn("k", F.xxhash64("g")).join(size, ["g", "k"]).drop("k").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    sets = m.join(_named(texts), ["id", "th"]).drop("th").mapInPandas(released(_whole_sets(width)), "id long, n long, g long, copies long, blocks long, block long, hs array<long>")
    cells = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.select("id", "g", "n", "copies", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "hs")
    # families of one block share buckets; a larger one has a group for each two blocks
    cells = cells.withColumn("cell", F.pmod(F.xxhash64("g", "i", "j"), F.lit(parts)))
    # a fixed number of tasks: by bytes Spark would join cells whose work is far larger than their size
    return cells.repartition(parts, "cell", "i", "j").groupBy("cell", "i", "j").applyInPandas(_compare(percent), "id long, links long, root long")


def _named(texts: DataFrame) -> DataFrame:
    return texts.dropDuplicates(["doc_id", "th"]).select(F.col("doc_id").alias("id"), "th", "text")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """pairs(a, ta, b, tb: ids and text hashes; a table) that link, by the whole texts.

    An id a that meets more than ``HUB`` others, and more than a thousandth of all pairs,
    has a slot for each such number of them, so no task takes all pairs of a hub. There
    are fewer than a thousand such ids, which bounds what is broadcast.
    """
    most = max(HUB, pairs.count() // 1000)
    hot = F.broadcast(pairs.groupBy("a", "ta").agg(F.ceil(F.count("*") / most).alias("slots")).where("slots > 1"))
    text = lambda x: texts.select(F.col("doc_id").alias(x), F.col("th").alias(f"t{x}"), F.col("text").alias(f"text_{x}")).dropDuplicates([x, f"t{x}"])
    slots = F.coalesce("slots", F.lit(1).cast("long"))
    first = text("a").join(pairs.select("a", "ta").distinct(), ["a", "ta"]).join(hot, ["a", "ta"], "left")
    first = first.select("a", "ta", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), slots - 1)).alias("slot"))
    j = pairs.join(hot, ["a", "ta"], "left").select("a", "ta", "b", "tb", F.pmod(F.xxhash64("b"), slots).alias("slot"))
    j = j.join(first, ["a", "ta", "slot"]).join(text("b"), ["b", "tb"])
    return j.select("a", "b", F.col("text_a").alias("ta"), F.col("text_b").alias("tb")).mapInPandas(released(_verify(width, percent)), "a long, b long")


def links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, count: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """docs(doc_id, text) -> (classes: doc_id, n, rep; edges between representatives: a, b, enough to connect each component; with count, rep and n_links)."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    sig = keep(texts.mapInPandas(released(_signatures(width, percent)), "doc_id long, th long, n long, s1 long, s2 long, low array<long>, sig array<long>"), "signatures")
    texts = texts.where("doc_id IS NOT NULL")
    full = sig.where("n > 0 AND doc_id IS NOT NULL")
    # joins with an aggregate take one more key than it: so both sides are dealt anew and Spark can split a hot key
    rep = full.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "th")).alias("r")).select("s1", "s2", F.xxhash64("s1").alias("k"), "r.doc_id", "r.th")
    of = rep.select("s1", "s2", "k", F.col("doc_id").alias("rep"))
    classes = sig.select("doc_id", "n", "s1", "s2", F.xxhash64("s1").alias("k")).join(of, ["s1", "s2", "k"], "left")
    classes = keep(classes.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "classes")
    one = rep.groupBy("doc_id").agg(F.min("th").alias("th"))
    own = keep(full.join(one, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "th", "n", "low", "sig"), "representatives")
    discard(sig)

    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    met = own.select("id", "th", "n", F.posexplode("low").alias("i", "m")).withColumn("k", F.xxhash64("m"))
    first = met.groupBy("i", "m").agg(F.min(F.struct("id", "th", "n")).alias("f"), F.count("*").alias("c")).where("c > 1").select("i", "m", F.xxhash64("m").alias("k"), "f")
    pairs = met.join(first, ["i", "m", "k"]).where((F.col("f.id") < F.col("id")) & fits(F.col("n"), F.col("f.n")))
    pairs = keep(pairs.select(F.col("f.id").alias("a"), F.col("f.th").alias("ta"), F.col("id").alias("b"), F.col("th").alias("tb")).distinct(), "star-pairs")
    star = keep(verified(pairs, texts, width, percent).distinct(), "star-links")
    discard(pairs)

    group = star.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("g"))
    grouped = own.drop("low").join(group, "id", "left").withColumn("g", F.coalesce("g", "id"))
    cell = grouped.select("id", "n", "g", F.explode("sig").alias("h"))
    shared = cell.groupBy("h").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("h")
    least = F.ceil(F.ceil(F.col("n") * percent / 100) / 10)
    rest = cell.join(shared, "h", "left_semi").groupBy("id", "n", "g").agg(F.count("*").alias("f")).where(F.col("f") >= least)
    roster = keep(grouped.select("id", "th", "n", "g"), "group-members")
    rest = keep(rest.select("id", "n", "g").join(roster.select("id", "th"), "id"), "open-documents")
    discard(own)

    # whole sets of the rest; twice: what the first pass closes makes shingles of others unique to their group
    sets = rest.join(_named(texts), ["id", "th"]).drop("th").mapInPandas(released(_whole_sets(width)), "id long, n long, g long, hs array<long>")
    once = keep(_met_elsewhere(sets, percent), "met-0")
    sets = keep(_met_elsewhere(once, percent), "met-1")
    discard(rest, once)
    opened = keep(_opened(sets, percent), "opened-groups")
    family = keep(components(opened), "families")
    discard(opened, sets)

    copies = classes.where("rep IS NOT NULL").groupBy(F.col("rep").alias("id")).agg(F.countDistinct("doc_id").alias("copies"))
    members = roster.join(family.withColumnRenamed("node", "g"), "g", "left")
    if count:
        members = members.join(copies, "id")
    else:  # groups that opened no other are connected already
        members = members.where("component IS NOT NULL").withColumn("copies", F.lit(1).cast("long"))
    members = members.select("id", "th", "n", F.coalesce("component", "g").alias("g"), "copies")
    within = keep(compared(members, texts, width, percent, buckets(docs)), "compared")
    found = star.unionByName(within.where("root <> id").select(F.col("root").alias("a"), F.col("id").alias("b")))
    if not count:
        discard(roster, family)
        return classes, found, None
    # equal sets link too
    each = copies.select("id", (F.col("copies") - 1).alias("links")).unionByName(within.select("id", "links"))
    return classes, found, each.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("n_links"))


def _opened(sets: DataFrame, percent: int) -> DataFrame:
    """sets(id, n, g, hs: rarest first) -> a, b: groups that some query's overlap with the other's token union opens."""
    # r counts from the shingle on: at the first one that two sets share, it bounds what they share
    probe = sets.select("id", "n", "g", F.size("hs").alias("r"), F.posexplode(F.slice("hs", F.lit(1), (F.size("hs") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))).alias("pos", "h")).withColumn("r", F.col("r") - F.col("pos"))
    matrix = probe.groupBy("h", F.col("g").alias("to")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("r").alias("most"))
    # two sets of n and m over the threshold overlap in t (n + m) / (1 + t); neither can overlap more than it meets elsewhere
    can = lambda r, n, m: (100 + percent) * r >= percent * (n + m)
    smallest = lambda n, lo: F.greatest(lo, F.ceil(n * percent / 100))
    near = lambda n, lo, hi: (100 * hi >= percent * n) & (100 * n >= percent * lo)
    n, lo, hi = F.col("n"), F.col("lo"), F.col("hi")
    named = probe.join(matrix, (probe["h"] == matrix["h"]) & (F.col("g") < F.col("to")) & near(n, lo, hi) & can(F.least("r", "most"), n, smallest(n, lo))).select("id", "to").distinct()
    # the query's overlap with each named group's token union, over all its shingles
    union = sets.select(F.col("g").alias("to"), F.explode("hs").alias("h")).distinct()
    asked = named.join(sets, "id").select("id", "n", "g", "to", F.explode("hs").alias("h"))
    overlap = asked.join(union, ["to", "h"]).groupBy("id", "n", "g", "to").agg(F.count("*").alias("r"))
    spread = sets.groupBy(F.col("g").alias("to")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return overlap.join(spread, "to").where(near(n, lo, hi) & can(F.col("r"), n, smallest(n, lo))).select(F.col("g").alias("a"), F.col("to").alias("b")).distinct()


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, count: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, rep (class of equal sets), component_id and, with count, n_links; one row per row of docs."""
    classes, found, linked = links(docs, width, percent, count)
    parts = components(found)
    joined = classes.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = joined.select("doc_id", F.col("n").alias("n_shingles"), "rep", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    if count:  # one more key than the aggregate: Spark can split the class of a hot text
        out, linked = out.withColumn("k", F.xxhash64("rep")), linked.withColumn("k", F.xxhash64("rep"))
    return out.join(linked, ["rep", "k"], "left").drop("k").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")) if count else out


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near duplicates: of each component the row with the smallest doc_id stays, one of equal rows.

    Rows without a doc_id link with nothing and all stay. Of rows that repeat a doc_id
    with different texts one stays.
    """
    found = keep(jaccard_join(docs, width, percent), "joined")
    ids = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_rows"))
    kept = docs.join(ids.select("_id"), docs["doc_id"] == F.col("_id"), "left_semi")
    if not ids.where("_rows > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id IS NULL"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), count=True).select("doc_id", "n_shingles", "component_id", "n_links")


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
cut AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - 1, 2)) END) AS i FROM d),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS x FROM cut),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM link UNION SELECT doc_id, b FROM reach JOIN link ON a = other),
root AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id),
deg AS (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id) LEFT JOIN deg USING (doc_id)
"""
