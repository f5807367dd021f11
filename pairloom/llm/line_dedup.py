"""Line dedup by content-defined chunks of lines (operator 10). DataFrame functions only.

Lines are hashed. A rolling hash over the hashes of two neighbouring lines with a word chooses where a chunk begins, so
boundaries follow content and come back wherever a passage does. Chunks of two such lines or more that occur again
anywhere in the corpus are removed, all but the first, once their bytes have been compared.

A passage also has lines before its first and after its last boundary, and a short one may have no boundary. So what chunks
have not settled is compared by windows, each from a line with a word to the next one; a window inside a removed chunk takes
no part in that (it stands earlier too, with the chunk). Together they find each run of two lines or more that stands earlier.
Only hashes are shuffled until a hash repeats; then the bytes of those chunks and windows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import boxed, in_box, keyed, materialize, release, unboxed


def _lines(df: DataFrame) -> DataFrame:
    return df.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))


def _spoken(x: Column) -> Column:
    return (x >= "!") | (F.ltrim(x, F.lit(" \t\x0b\x0c\r")) != "")


def _chunked(df: DataFrame, period: int) -> DataFrame:
    """Adds at (i, h, c: each line with a word, its hash and its chunk) and chunks (k0, k1: lines with a word from .. to, c).

    c: the chunk's first line << 32 | its number of lines; it ends before the next one's first line, so blank lines stay
    with the line before. Arrays enter lambdas as arguments only: the optimizer would compute a captured one for each element.
    """
    line = lambda x, i: F.when(_spoken(x), F.struct(i.alias("i"), F.xxhash64(x).alias("h")))
    df = df.withColumn("said", F.filter(F.transform("lines", line), lambda z: z.isNotNull()))
    begins = lambda a, b: F.pmod(F.xxhash64(a["h"], b["h"]), F.lit(period)) == 0
    pairs = F.zip_with(F.slice("said", F.lit(1), F.greatest(F.size("said") - 1, F.lit(0))), F.slice("said", F.lit(2), F.greatest(F.size("said") - 1, F.lit(0))), lambda a, b: F.struct(b["i"].alias("i"), begins(a, b).alias("cut")))
    first = F.transform(F.slice("said", 1, 1), lambda z: F.struct(z["i"].alias("i"), F.lit(True).alias("cut")))
    marks = F.transform(F.concat(first, pairs), lambda z, k: F.struct(z["i"].alias("i"), k.alias("k"), z["cut"].alias("cut")))
    df = df.withColumn("cuts", F.transform(F.filter(marks, lambda z: z["cut"]), lambda z: F.struct(z["i"].alias("i"), z["k"].alias("k"))))
    end = F.array(F.struct(F.size("lines").alias("i"), F.size("said").alias("k")))
    after = F.concat(F.slice("cuts", F.lit(2), F.greatest(F.size("cuts") - 1, F.lit(0))), end)
    after = F.slice(after, F.lit(1), F.size("cuts"))
    chunk = lambda a, b: F.struct(a["k"].alias("k0"), b["k"].alias("k1"), (F.shiftleft(a["i"].cast("long"), 32) + (b["i"] - a["i"])).alias("c"))
    df = df.withColumn("chunks", F.zip_with("cuts", after, chunk))
    each = F.flatten(F.transform("chunks", lambda x: F.array_repeat(x["c"], x["k1"] - x["k0"])))
    return df.withColumn("at", F.zip_with("said", each, lambda z, c: F.struct(z["i"].alias("i"), z["h"].alias("h"), c.alias("c"))))


def _chunks(df: DataFrame) -> DataFrame:
    """(rid, k, window): key k of each chunk of two lines with a word or more, start << 32 | number of lines."""
    # the hashes of all chunks as one string, cut where chunks begin: slices of an array would capture it in a lambda
    each = F.transform("at", lambda z: F.concat(F.when(F.shiftright(z["c"], 32) == z["i"], "|").otherwise(","), z["h"].cast("string")))
    parts = F.split(F.array_join(each, ""), r"\|")
    keyed = F.zip_with("chunks", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x, s: F.when(x["k1"] - x["k0"] > 1, F.struct(F.xxhash64(s).alias("k"), x["c"].alias("window"))))
    return df.select("rid", F.explode(keyed).alias("w")).filter("w IS NOT NULL").select("rid", "w.k", "w.window")


def _windows(df: DataFrame) -> DataFrame:
    """(rid, k, window, inside): key k of each window, start << 32 | number of lines, and the chunk that holds all of it.

    A window runs from a line with a word to the next one. If blank lines stand before or after, there is
    one with all of those too, so that they go with the passage. Equal windows have equal keys; blank
    lines do not enter them.
    """
    edge = lambda i: F.array(F.struct(i.alias("i"), F.lit(0).cast("long").alias("h"), F.lit(-1).cast("long").alias("c")))
    df = df.withColumn("at", F.concat(edge(F.lit(-1)), "at", edge(F.size("lines"))))
    from_ = lambda k: F.slice("at", F.lit(k), F.greatest(F.size("at") - 3, F.lit(0))).alias(f"p{k}")

    def near(z: Column) -> Column:
        i, c = ([None, *(z[f"p{k}"][x] for k in (1, 2, 3, 4))] for x in "ic")
        span = lambda a, b, held: F.struct(F.xxhash64(z["p2"]["h"], z["p3"]["h"], b - a).alias("k"), (F.shiftleft(a.cast("long"), 32) + (b - a + 1)).alias("window"), F.when(held, c[2]).alias("inside"))
        one = c[2] == c[3]
        return F.array(span(i[2], i[3], one), F.when(i[4] - i[3] > 1, span(i[2], i[4] - 1, one)), F.when(i[2] - i[1] > 1, span(i[1] + 1, i[3], one & (c[1] == c[2]))))

    found = df.select("rid", F.explode(F.flatten(F.transform(F.arrays_zip(*map(from_, (1, 2, 3, 4))), near))).alias("w"))
    return found.filter("w IS NOT NULL").select("rid", "w.k", "w.window", "w.inside")


def _again(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(rid, window) of those of hashes(rid, k, window) whose lines stand earlier too, as one of them. Bytes are compared."""
    again = hashes.groupBy("k").count().filter("count > 1").select("k")
    per_doc = hashes.join(again.hint("merge"), "k").groupBy("rid").agg(F.collect_list(F.struct("window", "k")).alias("found"))
    body = lambda x: F.array_join(F.slice("lines", _start(x["window"]) + 1, _count(x["window"])), "\n")
    texts = _lines(docs.select("rid", "text").join(per_doc.hint("merge"), "rid"))
    # `lines` is used twice, so that it is computed before the lambda and not in it
    texts = texts.select("rid", F.size("lines").alias("of"), F.transform("found", lambda x: F.struct(x["window"].alias("window"), x["k"].alias("k"), body(x).alias("body"))).alias("found"))
    bodies = materialize(texts.select("rid", "of", F.inline("found")), "bodies")
    firsts = bodies.groupBy("k", "body").agg(F.min(F.struct("rid", "window")).alias("f"), F.count("*").alias("c")).filter("c > 1").select("k", "body", "f")
    out = bodies.join(firsts.hint("merge"), ["k", "body"]).filter("rid <> f.rid OR window <> f.window").select("rid", "window")
    out = materialize(out, "again")
    release(bodies)
    return out


def _start(c: Column) -> Column:
    return F.shiftright(c, 32).cast("int")


def _count(c: Column) -> Column:
    return c.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def dedup_lines(docs: DataFrame, period: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, text (kept lines; null stays null), n_lines, n_removed, and the columns `keep`.

    A line goes if it lies in a run of lines, two of them with a word, that stands earlier too, by doc_id
    (null first) and place; the two may overlap. Of blank lines at a run's edge, all or none go. Repeated or null ids are
    separate documents in order of their text. Empty docs give no rows; columns of docs beyond doc_id,
    text and `keep` are ignored. period: mean number of lines with a word in a chunk; which lines go does not depend on it, only how
    many of them go with whole chunks. A document is held as its lines and their hashes, in time proportional to its length.
    """
    docs = keyed(docs.select("doc_id", "text", *keep), list(keep))
    lined = _chunked(_lines(docs.select("rid", "text")), period)
    whole = materialize(_chunks(lined), "chunks")
    chunks = _again(docs, whole)
    release(whole)
    hashes = _windows(lined).join(chunks.select("rid", F.col("window").alias("inside")).hint("merge"), ["rid", "inside"], "left_anti")
    hashes = materialize(hashes.select("rid", "k", "window"), "windows")
    windows = _again(docs, hashes)
    release(hashes)
    gone = chunks.unionByName(windows).groupBy("rid").agg(F.collect_list("window").alias("gone"))
    gone = materialize(gone.select("rid", F.array_distinct(F.flatten(F.transform("gone", lambda w: F.sequence(_start(w), _start(w) + _count(w) - 1)))).alias("gone")), "gone")
    release(chunks)
    release(windows)
    out = _lines(docs.join(gone.hint("merge"), "rid", "left"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.transform(stay, lambda i: F.get("lines", i))
    return out.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        *keep,
    )


def dedup_documents(docs: DataFrame, period: int = 4) -> DataFrame:
    """docs with their columns, and the texts that dedup_lines() leaves; n_chars follows where it exists.

    Every row stays, also where nothing of its text is left. Null texts stay null; repeated and null ids are
    documents of their own.
    """
    out = dedup_lines(boxed(docs), period, ("rest",))
    changed = {}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(in_box(docs.columns, "n_chars"))
    return unboxed(out, docs.columns, **changed)
