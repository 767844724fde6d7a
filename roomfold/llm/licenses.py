"""Licence scan with DataFrame functions only: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roomfold.llm.license_rules import GATE, RULES

# Phrases whose places are counted, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _places(words: Column, joined: Column, phrase: str) -> Column:
    """Word positions at which ``phrase`` starts."""
    parts = phrase.split()
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0)))

    def at(i: Column) -> Column:
        hit = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + k) == part)
        return F.coalesce(hit, F.lit(False))

    return F.when(joined.contains(f" {phrase} "), F.filter(starts, at)).otherwise(F.array().cast("array<int>"))


def _spans(joined: Column, regex: Column) -> Column:
    """Start and end of every match, from the matches and the text between them."""
    pattern = F.concat(F.lit("(?<= )(?:"), regex, F.lit(")(?= )"))
    pieces, matches = F.split(joined, pattern, -1), F.regexp_extract_all(joined, pattern, 0)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["piece"])
        end = begin + F.length(pair["match"])
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(
            F.struct(begin.alias("start"), end.alias("end")))).alias("spans"))

    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("piece"), matches.alias("match"))
    return F.when(F.size(matches) > 0, F.aggregate(pairs, start, add, lambda s: s["spans"])).otherwise(
        F.array().cast("array<struct<start:int,end:int>>"))


def _kept(found: Column) -> Column:
    """Detections that no earlier or longer one of the same or a higher priority contains.

    In the order (start, longest first, highest priority first) a detection lies inside another one
    exactly if some earlier one of its priority or above ends no sooner; the largest end seen at each
    priority is all that has to be carried along.
    """
    levels = max(r[0] for r in RULES) + 1
    kind = "array<struct<start:int,back:int,down:int,rule:int,label:string,weight:double>>"
    ends = F.array(*[F.lit(-1)] * levels)
    start = F.struct(ends.alias("ends"), F.array().cast(kind).alias("kept"))

    def add(state: Column, d: Column) -> Column:
        inside = F.exists(F.slice(state["ends"], 1 - d["down"], levels + d["down"]), lambda e: e >= -d["back"])
        return F.struct(
            F.transform(state["ends"], lambda e, i: F.when(i == -d["down"], F.greatest(e, -d["back"])).otherwise(e)).alias("ends"),
            F.when(inside, state["kept"]).otherwise(F.concat(state["kept"], F.array(d))).alias("kept"))

    return F.aggregate(F.array_sort(found.cast(kind)), start, add, lambda s: s["kept"])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, word count, places of the fixed phrases, and the licence detections with their spans.

    Words are runs of letters, digits and characters beyond ASCII of the lower-cased text; rules look
    at the words joined by one space. A cheap search for a few stems decides whether a text is looked
    at further; the rules whose keyword it holds are then matched, and a detection inside another one
    of no lower priority is dropped (equal spans: the higher priority, then the earlier rule).
    ``detections`` has start and end (characters of the joined words), rule, label and confidence.
    Null and empty texts have no words and no detection; repeated rows each get their result; other
    columns are not looked at. Everything happens inside the row: no shuffle, no Python.
    """
    rules = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(w).alias("weight"), F.lit(label).alias("label"),
                               F.lit(word).alias("keyword"), F.lit(regex).alias("regex"), F.lit(i).alias("rule"))
                      for i, (p, w, label, word, regex) in enumerate(RULES)])
    lowered = docs.select(F.col(key).alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_lower"))
    gate = F.lit(False)
    for stem in GATE:
        gate = gate | F.col("_lower").contains(stem)
    counted = lowered.select("id", F.regexp_count("_lower", F.lit(WORD)).cast("long").alias("n_words"),
                             F.when(gate, F.regexp_extract_all("_lower", F.lit(WORD), 0)).otherwise(
                                 F.array().cast("array<string>")).alias("_words"))
    joined = counted.withColumn("_joined", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")))
    for i, phrase in enumerate(PHRASES):
        joined = joined.withColumn(f"_p{i}", _places(F.col("_words"), F.col("_joined"), phrase))
    hits = F.filter(rules, lambda r: F.col("_joined").contains(r["keyword"]))
    found = F.flatten(F.transform(hits, lambda r: F.transform(_spans(F.col("_joined"), r["regex"]), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), (-r["priority"]).alias("down"), r["rule"].alias("rule"),
        r["label"].alias("label"), r["weight"].alias("weight")))))
    placed = joined.withColumn("_found", F.when(F.size("_words") > 0, found)).withColumn(
        "_kept", F.when(F.size("_found") > 0, _kept(F.col("_found"))))
    detections = F.coalesce(F.transform("_kept", lambda d: F.struct(
        d["start"].alias("start"), (-d["back"]).alias("end"), d["rule"].alias("rule"), d["label"].alias("label"),
        d["weight"].alias("confidence"))), F.array().cast(
            "array<struct<start:int,end:int,rule:int,label:string,confidence:double>>"))
    places = [F.col(f"_p{i}") for i in range(len(PHRASES))]
    return placed.select(
        "id", "n_words", sum((F.size(p) for p in places[1:]), F.size(places[0])).cast("long").alias("n_base"),
        F.least(*[F.array_min(p) for p in places]).cast("long").alias("first_word"),
        F.greatest(*[F.array_max(p) for p in places]).cast("long").alias("last_word"),
        F.filter(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(places, PHRASES.values())]),
                 lambda x: x.isNotNull()).alias("base"), detections.alias("detections"))
