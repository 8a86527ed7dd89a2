"""Retrieval stress: freshness, access, evidence sets, citations, abstention, and their reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.functions.text import bind, fold_apostrophes, strip
from verdictframe.operators.cluster import spread


def evidence_recall(retrieved: DataFrame, required: DataFrame) -> DataFrame:
    """Per case: evidence_set_recall (1 if some set is held in full) and best_recall (of the best set).

    retrieved has case_id and item, required has case_id, set_id and item. Relational division: counts of each
    set's items that were retrieved, so a set of any size is rows, never one value.
    """
    need = required.select("case_id", "set_id", "item", F.lit(1).alias("needed"), F.lit(None).cast("int").alias("held"))
    held = retrieved.where("case_id is not null and item is not null").select("case_id", F.lit(None).cast(required.schema["set_id"].dataType).alias("set_id"), "item", F.lit(0).alias("needed"), F.lit(1).alias("held"))
    # one shuffle by case and item takes the place of two distincts and a join
    rows = spread(need.unionByName(held), "case_id", "item").groupBy("case_id", "item", "set_id", "needed").agg(F.max("held").alias("held"))
    known = rows.withColumn("held", F.max("held").over(Window.partitionBy("case_id", "item"))).where("needed = 1")
    sets = known.groupBy("case_id", "set_id").agg(F.count(F.lit(1)).alias("n"), F.count("held").alias("k"))
    return sets.groupBy("case_id").agg(F.max((F.col("n") == F.col("k")).cast("double")).alias("evidence_set_recall"), F.max(F.col("k") / F.col("n")).alias("best_recall"))


def freshness_class(decision: Column, effective: Column, superseded: Column, digest: Column, seen_digest: Column) -> Column:
    """fresh, stale (superseded by then, or another digest), not_yet (not yet effective), untestable (no date)."""
    return (
        F.when(decision.isNull() | effective.isNull(), "untestable")
        .when(F.coalesce(superseded <= decision, F.lit(False)) | F.coalesce(digest != seen_digest, F.lit(False)), "stale")
        .when(effective > decision, "not_yet")
        .otherwise("fresh")
    )


def freshness(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Per case: n, freshness and stale_hit_rate of its hits (case_id, doc_id, decision_date, seen_digest).

    docs has doc_id, effective_date, superseded_date and digest. A document that isn't there, or has no date, can't
    be tested and counts in neither share; a case without a testable hit has null shares.
    """
    joined = hits.join(docs, "doc_id", "left")
    kind = freshness_class(F.col("decision_date"), F.col("effective_date"), F.col("superseded_date"), F.col("digest"), F.col("seen_digest"))
    by = joined.withColumn("kind", kind).groupBy("case_id")
    tested = F.count_if(F.col("kind") != "untestable")
    return by.agg(
        tested.alias("n"), F.try_divide(F.count_if(F.col("kind") == "fresh"), tested).alias("freshness"), F.try_divide(F.count_if(F.col("kind") == "stale"), tested).alias("stale_hit_rate")
    )


def changed_documents(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id of documents whose digest differs between two snapshots (doc_id, digest)."""
    b = after.select("doc_id", F.col("digest").alias("digest_after"))
    return before.join(b, "doc_id").where("digest <> digest_after").select("doc_id")


def invalidated(cited: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rows of cited (doc_id, digest) whose document is missing from the snapshot, or has another digest there."""
    s = snapshot.select("doc_id", F.col("digest").alias("digest_now"))
    return cited.join(s, "doc_id", "left").where("digest_now is null or digest_now <> digest").drop("digest_now")


def acl_compliance(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Per case: n, acl_compliance and unauthorized_hit_rate of hits (case_id, doc_id, groups array).

    docs has doc_id and acl (array; null can't be tested). A document that isn't there is a violation.
    """
    joined = hits.join(docs.withColumn("known", F.lit(True)), "doc_id", "left")
    violation = F.when(F.col("known").isNull(), True).when(F.col("acl").isNull(), None).otherwise(~F.arrays_overlap("acl", "groups"))
    by = joined.withColumn("violation", violation).groupBy("case_id")
    tested, bad = F.count("violation"), F.count_if("violation")
    return by.agg(tested.alias("n"), F.when(tested > 0, (bad == 0).cast("double")).alias("acl_compliance"), F.try_divide(bad, tested).alias("unauthorized_hit_rate"))


def citation_support(cited: DataFrame, declared: DataFrame, gold: DataFrame) -> DataFrame:
    """Per case: n, support (inside a declared span), precision (overlaps gold) and recall (of the gold spans).

    Spans are doc_id, start and end (exclusive); cited has case_id and cite_id besides, gold case_id and gold_id.
    Where cited and declared have a version, wrong_version_rate is the share of the citations whose span is declared in
    another version alone; they support nothing. Joins are equi-joins on the document with the span condition as
    residual; semi-joins keep them free of copies.
    """
    versioned = "version" in cited.columns and "version" in declared.columns
    c = cited.alias("c")
    inside = (F.col("c.doc_id") == F.col("d.doc_id")) & (F.col("d.start") <= F.col("c.start")) & (F.col("c.end") <= F.col("d.end"))
    meets = (F.col("c.doc_id") == F.col("g.doc_id")) & (F.col("c.case_id") == F.col("g.case_id")) & (F.col("c.start") < F.col("g.end")) & (F.col("g.start") < F.col("c.end"))
    n = cited.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    if versioned:
        placed = c.join(declared.alias("d"), inside, "left_semi")
        current = inside & (F.col("c.version").isNull() | F.col("d.version").isNull() | (F.col("c.version") == F.col("d.version")))
        wrong = placed.alias("c").join(declared.alias("d"), current, "left_anti").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_wrong"))
        n = n.join(wrong, "case_id", "left").fillna(0, ["n_wrong"])
        inside = current
    supported = c.join(declared.alias("d"), inside, "left_semi").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_supported"))
    precise = c.join(gold.alias("g"), meets, "left_semi").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_precise"))
    n_gold = gold.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_gold"))
    found = gold.alias("g").join(c, meets, "left_semi").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_found"))
    all_cases = n.join(supported, "case_id", "left").join(precise, "case_id", "left").join(n_gold, "case_id", "left").join(found, "case_id", "left").fillna(0)
    rate = [(F.col("n_wrong") / F.col("n")).alias("wrong_version_rate")] if versioned else []
    return all_cases.select(
        "case_id", "n", *rate, (F.col("n_supported") / F.col("n")).alias("support"), (F.col("n_precise") / F.col("n")).alias("precision"), F.try_divide(F.col("n_found"), F.col("n_gold")).alias("recall")
    )


#: Phrases that decline wherever they stand in the first sentence, those that decline at its beginning,
#: those that decline in a reply of so many words at most, and what opens an answer.
DECLINES = [
    "cannot answer", "can't answer", "unable to answer", "i don't have", "i do not have", "cannot provide", "i cannot", "unable to determine",
    "cannot determine", "i'm not able", "i am not able", "i am unable", "i'm unable",
]
DECLINING_OPENERS = ["insufficient information", "no information", "no relevant", "not able to", "there is no information", "there is insufficient information"]
DECLINES_SHORTLY = [
    r"\binsufficient information (?:to|for|in|about|regarding)\b",
    r"\bno (?:relevant )?information (?:about|on|regarding|in|to|for|that)\b",
    r"\bno relevant (?:information|documents?|context|passages?|sources?|data|results?)\b",
]
SHORT_WORDS, ANSWER = 25, "yes"


def declines(reply: Column) -> Column:
    """Whether the first sentence of a reply declines to answer; null without a reply.

    One expression holds what declines in any reply, another what declines in a short one that doesn't begin with a yes.
    """
    literal = lambda phrases: "|".join(re.escape(p) for p in phrases)
    always = f"(?:{literal(DECLINES)})|^[*_`'\" ]*(?:{literal(DECLINING_OPENERS)})"
    briefly = rf"(?s)^(?!\W*{ANSWER}\b).*?(?:{'|'.join(DECLINES_SHORTLY)})"
    plain = strip(F.lower(fold_apostrophes(reply)))
    first = F.split(plain, r"(?<=[.!?])\s+", 2)[0]

    def judged(sentence: Column, size: Column) -> Column:
        said = F.regexp_replace(sentence, r"\s+", " ")
        return F.when(size > 0, said.rlike(always) | ((size <= SHORT_WORDS) & said.rlike(briefly)))

    return bind(judged, first, F.when(plain != "", F.size(F.split(plain, r"\s+"))).otherwise(0))


def abstained(flag: Column, n_claims: Column, reply: Column) -> Column:
    """Whether a reply abstains: its explicit flag, else no claims, else by its phrases; null without any of these."""
    return F.when(flag.isNotNull(), flag).when(n_claims.isNotNull(), n_claims == 0).otherwise(declines(reply))


def number_values(text: Column) -> Column:
    """The distinct numbers of a text, commas ignored; -0 is 0."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\w.])-?\d[\d,]*(?:\.\d+)?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double") + F.lit(0.0)))


def numbers_held(want: Column, held: Column) -> Column:
    """1 when all wanted numbers are among those held, as of number_values(); null without any."""
    return F.when(F.size(want) > 0, (F.size(F.array_except(want, held)) == 0).cast("double"))


def numeric_accuracy(gold: Column, reply: Column) -> Column:
    """1 when every number of the gold answer stands in the reply, commas ignored; null without numbers."""
    return numbers_held(number_values(gold), number_values(reply))


def numeric_accuracy_of_groups(gold: DataFrame, replies: DataFrame, run: int = 4096) -> DataFrame:
    """case_id and numeric_accuracy of each gold answer (case_id, group, text) with every reply (group, text) of its group.

    The result has a row a pair, but only pairs that share a number are looked at: equal sets of numbers of a group are
    taken once, and a wanted set meets the replies that hold its rarest number. What remains is counted: so many replies hold
    all, so many don't, so many can't be told. These counts become rows in pieces of `run` at most, dealt to all tasks.
    """
    asked = gold.select("case_id", "group", number_values(F.col("text")).alias("want")).where(F.col("group").isNotNull())
    held = replies.select("group", number_values(F.col("text")).alias("held")).groupBy("group", "held").agg(F.count(F.lit(1)).alias("n"))
    sizes = held.groupBy("group").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("held").isNull(), F.col("n")).otherwise(0)).alias("untold"))
    postings = held.select("group", "held", "n", F.explode("held").alias("number"))
    often = postings.groupBy("group", "number").agg(F.count(F.lit(1)).alias("sets"))
    wanted = asked.select("group", "want").distinct().select("group", "want", F.explode("want").alias("number"))
    rarest = wanted.join(often, ["group", "number"], "left").groupBy("group", "want").agg(F.min_by("number", F.struct(F.coalesce("sets", F.lit(0)), "number")).alias("number"))
    found = rarest.join(postings, ["group", "number"]).where(numbers_held(F.col("want"), F.col("held")) == 1).groupBy("group", "want").agg(F.sum("n").alias("holding"))

    def some(value: float | None, rows: Column) -> Column:
        return F.struct(F.lit(value).cast("double").alias("value"), rows.cast("long").alias("rows"))

    holding, n, untold = F.coalesce("holding", F.lit(0)), F.col("n"), F.col("untold")
    runs = F.when(F.size("want") > 0, F.array(some(1.0, holding), some(0.0, n - untold - holding), some(None, untold))).otherwise(F.array(some(None, n)))
    counted = asked.join(sizes, "group").join(found, ["group", "want"], "left").select("case_id", F.inline(runs)).where("rows > 0")
    pieces = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / run))).alias("piece"))
    dealt = spread(pieces.select("case_id", "piece", "value", F.least(F.lit(run), F.col("rows") - F.col("piece") * run).cast("int").alias("rows")), "case_id", "piece")
    return dealt.select("case_id", F.explode(F.array_repeat("value", F.col("rows"))).alias("numeric_accuracy"))


def agreement(rows: DataFrame, *by: str) -> DataFrame:
    """Judge against human verdicts (booleans human, judge): confusion, agreement, Cohen's kappa and error rates.

    n_unlabeled rows lack a human verdict, n_missing_judge have one and lack the judge's; neither is in the confusion.
    Groups without a row that has both have a status unknown, and null rates.
    """
    h, j = F.col("human"), F.col("judge")
    missing = [F.count_if(h.isNull()).alias("n_unlabeled"), F.count_if(h.isNotNull() & j.isNull()).alias("n_missing_judge")]
    counts = rows.groupBy(*by).agg(*missing, F.count_if(h & j).alias("tp"), F.count_if(~h & j).alias("fp"), F.count_if(h & ~j).alias("fn"), F.count_if(~h & ~j).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    observed = F.try_divide(F.col("tp") + F.col("tn"), n)
    chance = F.try_divide((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("fn") + F.col("tn")) * (F.col("fp") + F.col("tn")), n * n)
    return counts.select(
        "*",
        n.alias("n"),
        observed.alias("agreement"),
        F.when(chance < 1, F.try_divide(observed - chance, 1 - chance)).alias("kappa"),
        F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_pass_rate"),
        F.try_divide(F.col("fn"), F.col("fn") + F.col("tp")).alias("false_negative_rate"),
        F.when(n > 0, "scored").otherwise("unknown").alias("status"),
    )


def calibration(rows: DataFrame, dimension: str) -> DataFrame:
    """agreement() overall and by a dimension (null is 'None'), by grouping sets: one scan, one shuffle."""
    named = rows.withColumn("dimension", F.coalesce(F.col(dimension).cast("string"), F.lit("None"))).where("human is not null and judge is not null")
    h, j = F.col("human"), F.col("judge")
    sets = named.groupingSets([[], ["dimension"]], "dimension")
    counts = sets.agg(F.count_if(h & j).alias("tp"), F.count_if(~h & j).alias("fp"), F.count_if(h & ~j).alias("fn"), F.count_if(~h & ~j).alias("tn"), F.grouping("dimension").alias("overall"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.select(F.when(F.col("overall") == 1, "(all)").otherwise(F.col("dimension")).alias("dimension"), "tp", "fp", "fn", "tn", n.alias("n"), F.try_divide(F.col("tp") + F.col("tn"), n).alias("agreement"))


BUCKETS = ["flagged", "clean", "unknown", "not_tested"]


def stress_matrix(rows: DataFrame) -> DataFrame:
    """kind x metric with a count for each bucket, zeros included."""
    return rows.groupBy("kind", "metric").pivot("bucket", BUCKETS).agg(F.count(F.lit(1))).fillna(0, BUCKETS)


def review_queue(cases: DataFrame, budget: int) -> DataFrame:
    """The cases most worth a review: 100 a disagreement, 10 with nothing measured, 5 an unknown, and 1 a utility."""
    if budget < 0:
        raise ValueError("budget must not be negative")
    priority = 100 * F.col("disagree").cast("int") + 10 * F.col("nothing").cast("int") + 5 * F.col("unknowns") + F.col("utility")
    return cases.withColumn("priority", priority.cast("double")).orderBy(F.col("priority").desc(), "case_id").limit(budget)


def operational_stress(calls: DataFrame, by: str, slo_ms: float, error_budget: float) -> DataFrame:
    """Per scenario: latencies p50 and p95, error and timeout rates, and whether objective and budget hold.

    Where calls say whether retrieval was partial and whether a false answer was given (partial, answered_falsely),
    also safe_degradation: that no call with partial retrieval was answered falsely; null without one that says so.
    """
    n = F.count("outcome")
    errors, timeouts = F.count_if(F.col("outcome") == "error"), F.count_if(F.col("outcome") == "timeout")
    rate = F.try_divide(errors + timeouts, n)
    p95 = F.percentile("latency_ms", 0.95)
    says = {"partial", "answered_falsely"} <= set(calls.columns)
    safe = [(~F.bool_or(F.when(F.col("partial"), F.col("answered_falsely")))).alias("safe_degradation")] if says else []
    return calls.groupBy(by).agg(
        F.percentile("latency_ms", 0.5).alias("p50"), p95.alias("p95"), F.try_divide(errors, n).alias("error_rate"), F.try_divide(timeouts, n).alias("timeout_rate"), (p95 <= slo_ms).alias("slo_met"), (rate <= error_budget).alias("within_budget"), *safe
    )


#: Stages of a retrieval pipeline in their order, and the stage that each metric tests.
STAGES = ["retrieval", "freshness", "access", "context", "citation", "answer", "abstention"]
STAGE_OF = {"evidence_set_recall": "retrieval", "freshness": "freshness", "acl_compliance": "access", "context_retention": "context", "citation_support": "citation", "numeric_accuracy": "answer", "abstention": "abstention"}


def stress_report(results: DataFrame) -> DataFrame:
    """Per case: what its stress arm flagged, the first failing stage, and whether its control arm is clean.

    results has case_id, kind, arm (stress or control), metric, value and status. A result is flagged when it was
    scored below 1; a control is clean when something was scored and nothing flagged.
    """
    scored = F.col("status").isNull() & F.col("value").isNotNull()
    flagged = scored & (F.col("value") < 1)
    stress, control = F.col("arm") == "stress", F.col("arm") == "control"
    order = F.create_map(*(x for m, s in STAGE_OF.items() for x in (F.lit(m), F.lit(STAGES.index(s)))))
    first = F.min(F.when(stress & flagged, F.element_at(order, F.col("metric"))))
    by = results.groupBy("case_id", "kind").agg(
        F.array_sort(F.collect_set(F.when(stress & flagged, F.col("metric")))).alias("flagged"),
        first.alias("first"),
        (F.coalesce(F.bool_or(control & scored), F.lit(False)) & ~F.coalesce(F.bool_or(control & flagged), F.lit(False))).alias("control_clean"),
    )
    return by.select("case_id", "kind", "flagged", F.get(F.array(*map(F.lit, STAGES)), F.col("first")).alias("first_failing_stage"), "control_clean")


def stress_cases(spark, n: int, seed: int = 0) -> DataFrame:
    """Results of a deterministic stress fixture: n cases of each kind, where each kind breaks one metric's stress arm."""
    kinds = list(STAGE_OF)
    rows = spark.range(n * len(kinds)).select(F.concat(F.lit("case"), F.col("id").cast("string")).alias("case_id"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % len(kinds) + 1).cast("int")).alias("kind"))
    each = rows.select("*", F.explode(F.array(F.lit("stress"), F.lit("control"))).alias("arm")).select("*", F.explode(F.array(*map(F.lit, kinds))).alias("metric"))
    jitter = F.pmod(F.xxhash64("case_id", F.lit(seed)), F.lit(50)) / 100
    value = F.when((F.col("arm") == "stress") & (F.col("metric") == F.col("kind")), jitter).otherwise(F.lit(1.0))
    return each.select("*", value.alias("value"), F.lit(None).cast("string").alias("status"))
