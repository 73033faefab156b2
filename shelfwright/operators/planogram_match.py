"""Planned rows against counted rows: candidate blocks, pair scores, one-to-one assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.functions import keys as K
from shelfwright.functions import location as L
from shelfwright.operators.matching import greedy_one_to_one
from shelfwright.session import cut_lineage

# Acceptance gates and scores of the matcher.
MATCHED, CLOSEST, BRAND_ONLY, UNCERTAIN = 0.72, 0.58, 0.55, 0.3
FLAVOUR_CAP = 0.29
# Scans of up to so many rows, planned and counted together, are compared row by row; larger ones meet through block keys.
DIRECT_ROWS = 200
PLACEHOLDERS = ["unverifiable", "unknown", "unidentified", "n/a", "na", "none", "null", "-", "—"]
UNREAD = ["UNVERIFIABLE", "UNKNOWN", "UNIDENTIFIED"]
# Words for the product class, and filler in flavour names.
CHIPS = r"\b(chips?|potato\s+chips?|crisps?|wafers?)\b"
FILLER = r"\b(spanish|american\s+style|india'?s?|classic)\b"
# Flavour phrases and the key they share, longest first.
FLAVOURS = [
    ("spanish tomato tango", "tomato tango"), ("tangy tomato", "tomato tango"), ("tomato tango", "tomato tango"),
    ("american style cream and onion", "cream and onion"), ("cream & onion", "cream and onion"),
    ("cream and onion", "cream and onion"), ("india's magic masala", "magic masala"),
    ("indias magic masala", "magic masala"), ("magic masala", "magic masala"),
]
# Pack and size words that never tell two variants apart.
PACK_WORDS = [
    "pack", "packs", "pc", "pcs", "piece", "pieces", "g", "gm", "gms", "kg", "ml", "l", "ltr", "x", "new", "combo",
    "pouch", "box", "jar", "bottle", "can", "family", "value", "mini", "jumbo", "big", "small", "large", "regular", "size", "and",
]


def _gap(text: Column) -> Column:
    return (text == "") | text.isin(PLACEHOLDERS)


def _without(words: Column, *more: str) -> Column:
    """Distinct words that are no placeholders."""
    return F.array_except(words, F.array(*[F.lit(w) for w in (*more, *PLACEHOLDERS)]))


def _tokens(*texts: Column) -> Column:
    return _without(F.split(F.concat_ws(" ", *texts), " "), "")


def with_texts(df: DataFrame, **cols: str) -> DataFrame:
    """``df`` with a squashed text of each column, made once however many features read it."""
    return df.withColumns({name: K.squash(F.col(of)) for name, of in cols.items()})


def with_flavour_key(df: DataFrame, name: str, *texts: str) -> DataFrame:
    """``df`` with ``name``: squashed variant and product texts reduced to one flavour key."""
    raw = F.trim(F.regexp_replace(F.concat_ws(" ", *texts), r"\s+", " "))
    df = df.withColumn(f"{name}_raw", raw)
    df = df.withColumn(f"{name}_text", F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.col(f"{name}_raw"), F.lit("&"), F.lit(" and ")), FILLER, " "), r"\s+", " ")))
    out = text = F.col(f"{name}_text")
    for phrase, canon in reversed(FLAVOURS):
        out = F.when(text.contains(phrase), canon).otherwise(out)
    return df.withColumn(name, F.when(_gap(F.col(f"{name}_raw")), "").otherwise(out)).drop(f"{name}_raw", f"{name}_text")


def _words(*texts: Column) -> Column:
    text = F.concat_ws(" ", *[F.replace(F.replace(t, F.lit("'"), F.lit("")), F.lit("&"), F.lit(" and ")) for t in texts])
    return _without(F.split(text, "[^a-z0-9]+"), "")


def _flavour_words(key: Column) -> Column:
    return F.array_distinct(F.split(key, " "))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the longer of two distinct token lists."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def _contains_either(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def counted_features(cv: DataFrame) -> DataFrame:
    c = F.col
    brand, prod, var, sku = c("brand"), c("product_name"), c("variant"), c("sku")
    cv = with_flavour_key(with_texts(cv, text_b="brand", text_p="product_name", text_v="variant"), "fk", "text_v", "text_p")
    tb, tp, tv = c("text_b"), c("text_p"), c("text_v")
    up = lambda col, d: F.upper(F.trim(F.coalesce(col, F.lit(d))))
    pu = up(c("product_status"), "IDENTIFIED").isin(UNREAD) | _gap(tp)
    vu = up(c("variant_status"), "").isin(UNREAD) | _gap(tv)
    bi = ~_gap(tb) & up(c("brand_status"), "IDENTIFIED").isin("IDENTIFIED", "MATCHED", "OK", "")
    blob = F.concat_ws(" ", _tokens(tp, tv, K.squash(c("sub_category")), K.squash(c("category"))))
    return cv.select("scan_id", F.col("pos").alias("j"), F.struct(
        K.brand_key(brand).alias("bk"), tp.alias("p"), K.squash(sku).alias("sku"),
        K.match_key(brand, prod, sku, None, var).alias("ident"), _tokens(tb, tp, tv).alias("tok"),
        c("fk").alias("fk"), _flavour_words(c("fk")).alias("fw"), _words(tb, tp, tv, c("fk")).alias("w"), blob.alias("blob"),
        pu.alias("pu"), vu.alias("vu"), bi.alias("bi"), tp.rlike(CHIPS).alias("chips")).alias("c"),
        K.brand_key(brand, prod).alias("bpk"), L.normalize_label(c("location_label")).alias("label"))


def planned_features(plan: DataFrame) -> DataFrame:
    c = F.col
    brand, prod, var, sku = c("brand"), c("product_name"), c("variant"), c("sku")
    plan = with_texts(plan, text_b="brand", text_p="product_name", text_v="variant")
    plan = with_flavour_key(with_flavour_key(plan, "fk", "text_v", "text_p"), "own_fk", "text_v")
    tb, tp, tv = c("text_b"), c("text_p"), c("text_v")
    own = F.array_except(_words(tp, tv, c("own_fk")), _words(tb))
    return plan.select("scan_id", F.col("pos").alias("i"), F.struct(
        K.brand_key(brand).alias("bk"), tp.alias("p"), K.squash(sku).alias("sku"),
        K.match_key(brand, prod, sku, None, var).alias("ident"), _tokens(tb, tp, tv).alias("tok"),
        c("fk").alias("fk"), _flavour_words(c("fk")).alias("fw"), own.alias("w"), K.squash(c("sub_category")).alias("sub"),
        tp.rlike(CHIPS).alias("chips")).alias("p"),
        K.brand_key(brand, prod).alias("bpk"), L.normalize_label(c("location")).alias("loc"))


def related_brands(keys_a: DataFrame, keys_b: DataFrame) -> DataFrame:
    """Brand keys that are equal or contain one another, over the distinct keys of both sides.

    Joined on a leading n-gram of the shorter key, never key by key.
    """
    def lead(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("bk").alias(name), F.substring("bk", 1, 3).alias("g"))

    def grams(df: DataFrame, name: str) -> DataFrame:
        k = F.col("bk")

        def of_length(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.length(k) - n + 1, F.lit(1)))
            return F.transform(starts, lambda s: F.substring(k, s, F.lit(n)))

        all_grams = F.concat(of_length(1), of_length(2), of_length(3))
        return df.select(k.alias(name), F.explode(F.array_distinct(all_grams)).alias("g"))

    a, b = keys_a.where("bk <> ''").distinct(), keys_b.where("bk <> ''").distinct()
    one = lead(a, "a").join(grams(b, "b"), "g").where(F.col("b").contains(F.col("a")))
    two = grams(a, "a").join(lead(b, "b"), "g").where(F.col("a").contains(F.col("b")))
    return one.select("a", "b").unionByName(two.select("a", "b")).distinct()


def large_scans(*sides: DataFrame, limit: int | None) -> DataFrame:
    """Scans with more rows than are compared directly; only scan numbers are shuffled."""
    ids = sides[0].select("scan_id")
    for other in sides[1:]:
        ids = ids.unionAll(other.select("scan_id"))
    return cut_lineage(ids.groupBy("scan_id").agg(F.count("*").alias("n")).where(F.col("n") > (DIRECT_ROWS if limit is None else limit)).select("scan_id"))


def _tells_apart(word: Column) -> Column:
    return ~word.isin(PACK_WORDS) & ~word.rlike("[0-9]")


def _words_by_scan(planned: DataFrame) -> DataFrame:
    """``planned`` with its distinctive words, for scans of bounded size: one shuffle, a scan's rows as one array."""
    def own(a: Column, every: Column) -> Column:
        # The row itself is among its relatives, so a word that only it uses is there once.
        related = F.filter(every, lambda o: (o["bk"] != "") & (a["bk"].contains(o["bk"]) | o["bk"].contains(a["bk"])))
        used = lambda r: K.let(F.flatten(F.transform(r, lambda o: o["w"])), lambda u: F.filter(
            a["w"], lambda x: _tells_apart(x) & (F.size(F.filter(u, lambda y: y == x)) == 1)))
        none = F.array().cast("array<string>")
        return F.when(a["bk"] == "", none).otherwise(K.let(related, lambda r: F.when(F.size(r) > 1, F.sort_array(used(r))).otherwise(none)))

    rest = [n for n in planned.columns if n != "scan_id"]
    scans = planned.groupBy("scan_id").agg(F.collect_list(F.struct(*rest)).alias("rows"))
    every = F.transform("rows", lambda r: F.struct(r["p"]["bk"].alias("bk"), r["p"]["w"].alias("w")))
    out = scans.select("scan_id", "rows", every.alias("every")).select(
        "scan_id", F.inline(F.arrays_zip("rows", F.transform("every", lambda a: own(a, F.col("every"))).alias("dist"))))
    return out.select("scan_id", *[F.col(f"rows.{n}").alias(n) for n in rest], F.when(F.size("dist") > 0, F.col("dist")).alias("dist"))


def _words_by_key(planned: DataFrame) -> DataFrame:
    """(scan_id, i, dist), by joins on words and brands, for scans of any size."""
    base = planned.select("scan_id", "i", F.col("p.bk").alias("bk"), F.col("p.w").alias("w"))
    rel = related_brands(base.select("bk"), base.select("bk"))
    w = base.select("scan_id", "i", "bk", F.explode("w").alias("word"))
    per = w.groupBy("scan_id", F.col("bk").alias("b"), "word").agg(F.count("*").alias("n"))
    uses = w.join(rel, F.col("bk") == F.col("a")).join(per, ["scan_id", "b", "word"]).groupBy("scan_id", "i", "word").agg(F.sum("n").alias("n"))
    keep = uses.where(F.col("n") == 1).where(_tells_apart(F.col("word")))
    rows = base.groupBy("scan_id", F.col("bk").alias("b")).agg(F.count("*").alias("rows"))
    sib = base.select("scan_id", "bk").distinct().join(rel, F.col("bk") == F.col("a")).join(rows, ["scan_id", "b"]).groupBy("scan_id", "bk").agg(
        F.sum("rows").alias("rows")).where("rows > 1")
    out = keep.join(base.select("scan_id", "i", "bk"), ["scan_id", "i"]).join(sib, ["scan_id", "bk"], "left_semi")
    # A planned row has a handful of words, so its own list is small by construction.
    return out.groupBy("scan_id", "i").agg(F.sort_array(F.collect_list("word")).alias("dist"))


def distinctive_words(planned: DataFrame, limit: int | None = None) -> DataFrame:
    """(scan_id, i, dist): words only one planned row uses among the rows of its own or a containing brand in the scan."""
    slim = planned.select("scan_id", "i", F.struct(F.col("p.bk").alias("bk"), F.col("p.w").alias("w")).alias("p"))
    by_scan = lambda rows: _words_by_scan(rows).where("dist IS NOT NULL").select("scan_id", "i", "dist")
    big = large_scans(planned, limit=limit)
    if big.isEmpty():
        return by_scan(slim)
    return by_scan(slim.join(big, "scan_id", "left_anti")).unionByName(_words_by_key(cut_lineage(slim.join(big, "scan_id", "left_semi"))))


def pair_score(c: str = "c", p: str = "p", dist: str = "dist") -> Column:
    """Score of a counted row against a planned row."""
    cf, pf = (lambda n: F.col(f"{c}.{n}")), (lambda n: F.col(f"{p}.{n}"))
    over = overlap(cf("tok"), pf("tok"))
    equiv = _contains_either(cf("fk"), pf("fk"))
    same_product = _contains_either(cf("p"), pf("p")) & ((cf("p") == pf("p")) | (~cf("p").isin(PLACEHOLDERS) & ~pf("p").isin(PLACEHOLDERS)))
    named = ~cf("pu") & ~cf("vu")
    v_over = overlap(cf("fw"), pf("fw"))
    v_over = F.when((cf("fk") != "") & (pf("fk") != ""), v_over).otherwise(0.0)
    brand_score = F.greatest(
        F.when(cf("pu"), 0.62).otherwise(0.58),
        F.when(~cf("pu") & cf("vu") & same_product, 0.70).otherwise(0.0),
        F.when(named & equiv & (same_product | cf("chips") | pf("chips")), 0.88).otherwise(0.0),
        F.when(named & (v_over >= 0.25), F.bround(0.55 + 0.45 * v_over, 3)).otherwise(0.0),
        F.when((pf("sub") != "") & cf("blob").contains(pf("sub")), 0.68).otherwise(0.0))
    branded = cf("bi") & _contains_either(cf("bk"), pf("bk"))
    fuzzy = F.when(branded, F.greatest(over, brand_score)).otherwise(over)
    d = F.coalesce(F.col(dist), F.array().cast("array<string>"))
    conflict = (F.size(d) > 0) & named & ~equiv & ~F.arrays_overlap(d, cf("w"))
    return (
        F.when((cf("sku") != "") & (cf("sku") == pf("sku")) & ~cf("sku").isin(PLACEHOLDERS), 1.0)
        .when(cf("ident") == pf("ident"), 0.95)
        .when(conflict, F.least(fuzzy, F.lit(FLAVOUR_CAP))).otherwise(fuzzy))


def accept_threshold(c: str = "c") -> Column:
    cf = lambda n: F.col(f"{c}.{n}")
    return F.when(~cf("bi"), MATCHED).when(cf("pu") | cf("vu"), BRAND_ONLY).otherwise(CLOSEST)


def match_status(score: Column, c: str = "c") -> Column:
    cf = lambda n: F.col(f"{c}.{n}")
    named = ~cf("pu") & ~cf("vu")
    return (
        F.when((score >= MATCHED) & named, "MATCHED").when((score >= CLOSEST) & cf("bi") & named, "MATCHED")
        .when((score >= BRAND_ONLY) & cf("bi"), "BRAND_MATCHED").when(score >= UNCERTAIN, "UNVERIFIABLE").otherwise("NOT_FOUND"))


def prepare(cv: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The columns of both sides that the matcher reads; several branches read them, so they are written once."""
    both = ("scan_id", "pos", "brand", "product_name", "variant", "sku", "sub_category")
    return (cut_lineage(cv.select(*both, "category", "brand_status", "product_status", "variant_status", "location_label")),
            cut_lineage(plan.select(*both, "location")))


def _with_score(pairs: DataFrame) -> DataFrame:
    # As a generated column the score is computed once; as a plain one the filter would compute it again.
    return pairs.withColumn("score", F.explode(F.array(pair_score()))).where("score > 0")


def _flags(c: str = "c") -> Column:
    return F.struct(*[F.col(f"{c}.{n}").alias(n) for n in ("pu", "vu", "bi")]).alias("c")


def scored_pairs(cv: DataFrame, plan: DataFrame, limit: int | None = None) -> DataFrame:
    """Pairs of a scan with a score above zero, from the columns of ``prepare``.

    The rows of a scan of bounded size are shuffled once, before they have features, and meet on the scan; no pair is
    shuffled. Rows of larger scans meet on block keys.
    """
    big = large_scans(cv, plan, limit=limit)
    columns = ["scan_id", "i", "j", "score", "c", "label", "loc"]

    def direct(a: DataFrame, b: DataFrame) -> DataFrame:
        c = counted_features(a.repartition("scan_id")).select("scan_id", "j", "c", "label")
        p = _words_by_scan(planned_features(b.repartition("scan_id")).drop("bpk"))
        return _with_score(c.join(p, "scan_id")).withColumn("c", _flags()).select(*columns)

    if big.isEmpty():
        return direct(cv, plan)
    lc, lp = cut_lineage(counted_features(cv.join(big, "scan_id", "left_semi"))), cut_lineage(planned_features(plan.join(big, "scan_id", "left_semi")))
    by_blocks = _pairs_by_blocks(lc, cut_lineage(lp.join(_words_by_key(lp), ["scan_id", "i"], "left")))
    return direct(*(side.join(big, "scan_id", "left_anti") for side in (cv, plan))).unionByName(by_blocks.select(*columns))


def _pairs_by_blocks(c: DataFrame, p: DataFrame) -> DataFrame:
    """Pairs of a scan that share a brand, a token, an identity or a SKU, each with its score.

    A pair without any of these scores zero, so the equi-join on block keys loses nothing. Equal rows
    are scored once: the join runs on distinct descriptors of a scan and is expanded to rows after.
    """
    c, p = c.withColumn("cid", F.xxhash64("c")), p.withColumn("pid", F.xxhash64("p", "dist"))
    rel = related_brands(c.select("c.bk"), p.select("p.bk"))
    cd = c.select("scan_id", "cid", "c").dropDuplicates(["scan_id", "cid"])
    pd_ = p.select("scan_id", "pid", "p", "dist").dropDuplicates(["scan_id", "pid"])
    tok = lambda f: F.transform(F.col(f"{f}.tok"), lambda t: F.concat(F.lit("t:"), t))
    key = lambda f, n, t: F.when(F.col(f"{f}.{n}") != "", F.array(F.concat(F.lit(t), F.col(f"{f}.{n}")))).otherwise(F.array().cast("array<string>"))
    brands = rel.groupBy(F.col("a").alias("bk")).agg(F.collect_set(F.concat(F.lit("b:"), "b")).alias("bs"))  # a few containing names per brand
    cb = cd.withColumn("bk", F.col("c.bk")).join(brands, "bk", "left").withColumn(
        "block", F.explode(F.concat(tok("c"), key("c", "sku", "s:"), key("c", "ident", "i:"), F.coalesce("bs", F.array().cast("array<string>"))))).select("scan_id", "block", "cid")
    pb = pd_.withColumn("block", F.explode(F.concat(tok("p"), key("p", "sku", "s:"), key("p", "ident", "i:"), key("p", "bk", "b:")))).select("scan_id", "block", "pid")
    cand = cb.join(pb, ["scan_id", "block"]).select("scan_id", "cid", "pid").distinct()
    scored = _with_score(cand.join(cd, ["scan_id", "cid"]).join(pd_, ["scan_id", "pid"]))
    slim = scored.select("scan_id", "cid", "pid", "score", _flags())
    return slim.join(c.select("scan_id", "j", "cid", "label"), ["scan_id", "cid"]).join(
        p.select("scan_id", "i", "pid", "loc"), ["scan_id", "pid"]).drop("cid", "pid")


def join_planogram(cv: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per planned row with its counted row, plus counted rows left over as UNPLANNED.

    Columns: scan_id, i (planned), j (counted), match_status, match_score, residual.
    """
    cv, plan = prepare(cv, plan)
    c, p = counted_features(cv), planned_features(plan)
    bonus = F.when(L.fits(F.col("label"), F.col("loc")), 0.05).otherwise(0.0)
    pairs = cut_lineage(scored_pairs(cv, plan).withColumn("bonus", bonus).drop("label", "loc"))
    deferred = F.col("c.vu") & ~F.col("c.pu") & (F.col("score") < MATCHED)
    ok = pairs.where((F.col("score") >= accept_threshold()) & ~deferred)
    taken = greedy_one_to_one(ok, "scan_id", "i", "j", [-F.col("score"), -F.col("bonus")], with_order=False)
    first = taken.join(pairs, ["scan_id", "i", "j"]).select(
        "scan_id", "i", "j", match_status(F.col("score")).alias("match_status"), F.bround("score", 3).alias("match_score"))
    # Planned rows still open: best score over counted rows nobody took.
    open_pairs = pairs.join(taken.select("scan_id", "i"), ["scan_id", "i"], "left_anti").join(
        taken.select("scan_id", "j"), ["scan_id", "j"], "left_anti")
    best = open_pairs.groupBy("scan_id", "i").agg(F.max_by(
        F.struct("score", deferred.alias("d")), F.struct("score", -F.col("j"))).alias("b"))
    left = p.select("scan_id", "i", F.col("bpk").alias("bk"), F.col("p.p").alias("pk")).join(
        taken.select("scan_id", "i"), ["scan_id", "i"], "left_anti").join(best, ["scan_id", "i"], "left")
    score = F.coalesce("b.score", F.lit(0.0))
    left = left.select("scan_id", "i", "bk", F.when(F.col("pk").isin(PLACEHOLDERS), "").otherwise(F.col("pk")).alias("pk"),
                       score.alias("score"), F.when(F.col("b").isNull(), "NOT_FOUND").when(F.col("b.d"), "UNVERIFIABLE")
                       .when(score < UNCERTAIN, "NOT_FOUND").otherwise("UNVERIFIABLE").alias("st"))
    # Residual: exactly one open planned row and one unread-variant row of a brand and product.
    feat = c.withColumn("bk", F.col("bpk")).join(taken.select("scan_id", "j"), ["scan_id", "j"], "left_anti")
    one_c = feat.where(F.col("c.bi") & ~F.col("c.pu") & F.col("c.vu")).groupBy("scan_id", "bk", F.col("c.p").alias("pk")).agg(
        F.count("*").alias("n"), F.min("j").alias("j")).where("n = 1 AND bk <> '' AND pk <> ''")
    one_p = left.where("bk <> '' AND pk <> ''").groupBy("scan_id", "bk", "pk").agg(F.count("*").alias("m"), F.min("i").alias("i")).where("m = 1")
    res = one_p.join(one_c, ["scan_id", "bk", "pk"]).select("scan_id", "i", "j").join(
        pairs.select("scan_id", "i", "j", "score"), ["scan_id", "i", "j"], "left").select(
        "scan_id", "i", "j", F.bround(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.70)), 3).alias("rs"))
    rest = left.join(res, ["scan_id", "i"], "left").select(
        "scan_id", "i", "j", F.when(F.col("j").isNotNull(), "BRAND_MATCHED").otherwise(F.col("st")).alias("match_status"),
        F.coalesce("rs", F.bround("score", 3)).alias("match_score"))
    rows = cut_lineage(first.unionByName(rest))
    extra = c.select("scan_id", "j").join(rows.where("j IS NOT NULL").select("scan_id", "j"), ["scan_id", "j"], "left_anti").select(
        "scan_id", F.lit(None).cast("bigint").alias("i"), "j", F.lit("UNPLANNED").alias("match_status"), F.lit(None).cast("double").alias("match_score"))
    return rows.unionByName(extra)


def fold_locations(rows: DataFrame, cv: DataFrame, plan: DataFrame) -> DataFrame:
    """Facings of the same product in more labelled bins, added to the row that expects no bin.

    ``rows`` is the result of ``join_planogram``. The earliest planned row of an identity takes them.
    """
    ident = K.match_key(F.col("brand"), F.col("product_name"), None, None, F.col("variant"))
    c = cv.select("scan_id", F.col("pos").alias("j"), ident.alias("ident"), K.match_key(
        F.col("brand"), F.col("product_name"), F.col("sku"), None, F.col("variant")).alias("full"),
        L.normalize_label(F.col("location_label")).alias("label"), "actual_facings")
    open_bin = plan.where(L.normalize_label(F.col("location")) == "").select("scan_id", F.col("pos").alias("i"))
    target = rows.where("i IS NOT NULL AND j IS NOT NULL").join(open_bin, ["scan_id", "i"]).join(
        c.select("scan_id", "j", "ident"), ["scan_id", "j"]).where("ident <> ''").groupBy("scan_id", "ident").agg(F.min("i").alias("i"))
    spare = rows.where("match_status = 'UNPLANNED'").select("scan_id", "j").join(
        c.select("scan_id", "j", F.col("full").alias("ident"), "label", "actual_facings"), ["scan_id", "j"]).where("label <> ''")
    return spare.join(target, ["scan_id", "ident"]).groupBy("scan_id", "i").agg(
        F.sum(F.coalesce("actual_facings", F.lit(0))).alias("extra_facings"), F.count("*").alias("extra_locations"))
