"""Scores of extracted graphs against expected ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.columns import harmonic, ratio, text_or_empty
from factloom.operators.grouped import cumulative_at

FACT_KEY = ("edge_label", "fact_type", "from_entity", "to_entity")
LABELS = ("AFFILIATED", "ASSERTED", "TRANSITIONED")


def _low(column: str) -> Column:
    return F.lower(text_or_empty(column))


# -- keyed facts ------------------------------------------------------------------------------


def fact_matches(
    expected: DataFrame, extracted: DataFrame, match_on: Sequence[str] = FACT_KEY
) -> DataFrame:
    """Distinct keys of both sides with their outcome: matched, missing or extra."""

    return _counted(expected, extracted, {c: _low(c) for c in match_on}).withColumn(
        "outcome",
        F.when(F.col("n_extracted") == 0, "missing")
        .when(F.col("n_expected") == 0, "extra")
        .otherwise("matched"),
    )


def _counted(expected: DataFrame, extracted: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows per key on either side: both sides go into one aggregate, so nothing is joined."""
    named = [column.alias(name) for name, column in keys.items()]
    tagged = expected.select(*named, F.lit(1).alias("_side")).unionByName(
        extracted.select(*named, F.lit(2).alias("_side"))
    )
    return tagged.groupBy(*keys).agg(
        F.count_if(F.col("_side") == 1).alias("n_expected"),
        F.count_if(F.col("_side") == 2).alias("n_extracted"),
    )


def fact_scores(
    expected: DataFrame, extracted: DataFrame, match_on: Sequence[str] = FACT_KEY
) -> DataFrame:
    """Precision, recall and F1. Matches are distinct keys, totals count every row."""
    m = fact_matches(expected, extracted, match_on)
    sums = m.agg(
        F.count_if(F.col("outcome") == "matched").alias("matched"),
        F.coalesce(F.sum("n_expected"), F.lit(0)).alias("expected"),
        F.coalesce(F.sum("n_extracted"), F.lit(0)).alias("extracted"),
        F.count_if(F.col("outcome") == "missing").alias("missing"),
        F.count_if(F.col("outcome") == "extra").alias("extra"),
    )
    return with_scores(sums, "matched", "extracted", "expected")


def with_scores(
    df: DataFrame, matched: str, extracted: str, expected: str, prefix: str = ""
) -> DataFrame:
    p, r = f"{prefix}precision", f"{prefix}recall"
    return df.withColumns(
        {p: ratio(matched, extracted, 1.0), r: ratio(matched, expected, 1.0)}
    ).withColumn(f"{prefix}f1", harmonic(p, r))


def matched_keys(expected: DataFrame, extracted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct keys on both sides."""
    return _keys_of(expected, extracted, columns, "matched")


def missing_keys(expected: DataFrame, extracted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct keys on the first side only; swap the sides for extra keys."""
    return _keys_of(expected, extracted, columns, "missing")


def _keys_of(expected: DataFrame, extracted: DataFrame, columns: Sequence[str], outcome: str):
    found = fact_matches(expected, extracted, columns)
    return found.filter(F.col("outcome") == outcome).select(*columns)


# -- matching per record ----------------------------------------------------------------------


def _record_fact_keys() -> dict[str, Column]:
    return {
        "record_id": F.col("record_id"),
        "edge_label": F.upper(text_or_empty("edge_label")),
        "fact_type": _low("fact_type"),
        "from_entity": _low("from_entity"),
        "to_entity": _low("to_entity"),
    }


def match_facts(extracted: DataFrame, expected: DataFrame, by_label: bool = False) -> DataFrame:
    """Per record: facts matched one to one, extracted and expected.

    Pairing equal keys one to one matches the smaller of the two counts of each key.
    """
    counts = _counted(expected, extracted, _record_fact_keys())
    group = ["record_id", "edge_label"] if by_label else ["record_id"]
    return counts.groupBy(*group).agg(
        F.sum(F.least("n_extracted", "n_expected")).alias("fact_matched"),
        F.sum("n_extracted").alias("fact_extracted"),
        F.sum("n_expected").alias("fact_expected"),
    )


def match_entities(extracted: DataFrame, expected: DataFrame) -> DataFrame:
    """Per record: entities matched, extracted and expected.

    `expected` has record_id, position, name, type and alias (one row per form). A name or alias
    that two expected entities share belongs to the later one; types must agree; each expected
    entity counts once.
    """
    forms = expected.select(
        "record_id",
        "position",
        _low("type").alias("_type"),
        F.explode(F.array(_low("name"), _low("alias"))).alias("_form"),
    ).filter(F.col("_form") != "")
    owners = forms.groupBy("record_id", "_form").agg(
        F.max(F.struct("position", "_type")).alias("_owner")
    )
    names = extracted.select("record_id", _low("name").alias("_form"), _low("type").alias("_type"))
    hits = (
        names.distinct()
        .join(owners, ["record_id", "_form"])
        .filter(F.col("_type") == F.col("_owner._type"))
        .groupBy("record_id")
        .agg(F.count_distinct("_owner.position").alias("entity_matched"))
    )
    got = extracted.groupBy("record_id").agg(F.count(F.lit(1)).alias("entity_extracted"))
    want = expected.groupBy("record_id").agg(
        F.count_distinct("position").alias("entity_expected")
    )
    counts = ["entity_matched", "entity_extracted", "entity_expected"]
    return (
        got.join(want, "record_id", "full_outer")
        .join(hits, "record_id", "left")
        .fillna(0, counts)
        .select("record_id", *counts)
    )


def per_label_counts(extracted: DataFrame, expected: DataFrame) -> DataFrame:
    """Matched, extracted and expected facts per record and label as columns."""
    long = match_facts(extracted, expected, by_label=True)
    measures = ("matched", "extracted", "expected")

    def cell(label: str, measure: str) -> Column:
        chosen = F.when(F.col("edge_label") == label, F.col(f"fact_{measure}"))
        return F.coalesce(F.sum(chosen), F.lit(0)).alias(f"{label.lower()}_{measure}")

    return long.groupBy("record_id").agg(*[cell(name, m) for name in LABELS for m in measures])


def confidence_mismatches(extracted: DataFrame, expected: DataFrame) -> DataFrame:
    """Equal facts with different confidence: one row per pair of confidences, with its count.

    Counted per confidence value, so many equal facts do not multiply into pairs.
    """

    keys = _record_fact_keys()

    def counted(df: DataFrame, side: str) -> DataFrame:
        confidence = text_or_empty("confidence").alias(f"{side}_confidence")
        named = [column.alias(name) for name, column in keys.items()]
        return df.groupBy(*named, confidence).agg(F.count(F.lit(1)).alias(f"n_{side}"))

    joined = counted(extracted, "extracted").join(counted(expected, "expected"), list(keys))
    differ = F.col("extracted_confidence") != F.col("expected_confidence")
    return joined.filter(differ).select(
        *keys,
        "extracted_confidence",
        "expected_confidence",
        (F.col("n_extracted") * F.col("n_expected")).alias("warnings"),
    )


def _fact_counts(extracted: DataFrame, expected: DataFrame) -> DataFrame:
    """Per key: facts matched, extracted and expected, and pairs of equal facts that differ in confidence.

    Of n extracted and m expected facts of a key n * m pairs are equal, less those of equal confidence.
    """
    keys = _record_fact_keys()

    def told(df: DataFrame, side: int) -> DataFrame:
        named = [column.alias(name) for name, column in keys.items()]
        confidence = text_or_empty("confidence").alias("_confidence")
        return df.select(*named, confidence, F.lit(1 - side).alias("_got"), F.lit(side).alias("_want"))

    each = told(extracted, 0).unionByName(told(expected, 1)).groupBy(*keys, "_confidence")
    each = each.agg(F.sum("_got").alias("_got"), F.sum("_want").alias("_want"))
    got, want = F.sum("_got"), F.sum("_want")
    return each.groupBy(*keys).agg(
        F.least(got, want).alias("fact_matched"),
        got.alias("fact_extracted"),
        want.alias("fact_expected"),
        (got * want - F.sum(F.col("_got") * F.col("_want"))).alias("confidence_warnings"),
    ).select("record_id", "edge_label", "fact_matched", "fact_extracted", "fact_expected", "confidence_warnings")


def _entity_counts(extracted: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of entity_matched, entity_extracted and entity_expected whose sums are those of `match_entities`."""
    long, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    got = extracted.select(
        "record_id", _low("name").alias("_form"), _low("type").alias("_type"), long.alias("_position"),
        F.lit(1).alias("_got"),
    )
    # an expected entity stands under each of its forms, and once without a form for itself
    forms = F.array(_low("name"), _low("alias"), text)
    want = expected.select(
        "record_id", F.explode(forms).alias("_form"), _low("type").alias("_type"),
        F.col("position").cast("long").alias("_position"), F.lit(0).alias("_got"),
    ).filter("_form IS NULL OR _form <> ''")
    alone = F.when(F.col("_form").isNull(), F.col("_position")).alias("_alone")
    is_want = F.col("_got") == 0
    met = got.unionByName(want).groupBy("record_id", "_form", alone).agg(
        F.max(F.when(is_want, F.struct("_position", "_type"))).alias("_owner"),
        F.collect_set(F.when(~is_want, F.col("_type"))).alias("_types"),
        F.sum("_got").alias("_got"),
    )
    hit = F.array_contains("_types", F.col("_owner._type")) & (F.col("_form") != "")
    owners = met.groupBy("record_id", F.col("_owner._position").alias("_position")).agg(
        F.max(F.coalesce(hit, F.lit(False)).cast("long")).alias("entity_matched"),
        F.sum("_got").alias("entity_extracted"),
    )
    counted = F.col("_position").isNotNull().cast("long").alias("entity_expected")
    return owners.select("record_id", "entity_matched", "entity_extracted", counted)


def score_records(
    records: DataFrame,
    extracted_entities: DataFrame,
    expected_entities: DataFrame,
    extracted_facts: DataFrame,
    expected_facts: DataFrame,
) -> DataFrame:
    """All per-record scores. `records` has record_id (once each) and is_noise.

    Every input is read once. Facts meet under their key and confidence, then under their key, entities
    under their forms, then under their positions; what comes of that is rows of counts, which are put under
    the records and summed once. A record of very many facts or entities is spread over its keys until then.
    """
    none = F.lit(None).cast("long")
    facts = _fact_counts(extracted_facts, expected_facts)
    entities = _entity_counts(extracted_entities, expected_entities)
    measures = ("matched", "extracted", "expected")
    counts = [f"{kind}_{m}" for kind in ("entity", "fact") for m in measures]
    labels = [f"{name.lower()}_{m}" for name in LABELS for m in measures]
    rows = records.select("record_id", "is_noise", F.lit(True).alias("_known"))
    for part in (entities, facts):
        rows = rows.unionByName(part, allowMissingColumns=True)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts]
    for name in LABELS:
        at = F.col("edge_label") == name
        for m in measures:
            chosen = F.sum(F.when(at, F.col(f"fact_{m}")).otherwise(none))
            sums.append(F.coalesce(chosen, F.lit(0)).alias(f"{name.lower()}_{m}"))
    warned = F.coalesce(F.sum("confidence_warnings"), F.lit(0)).alias("confidence_warnings")
    summed = rows.groupBy("record_id").agg(F.max("is_noise").alias("is_noise"), F.max("_known").alias("_known"), *sums, warned)
    joined = summed.filter("_known").select("record_id", "is_noise", *counts, *labels, "confidence_warnings")
    scored = with_scores(
        with_scores(joined, "entity_matched", "entity_extracted", "entity_expected", "entity_"),
        "fact_matched",
        "fact_extracted",
        "fact_expected",
        "fact_",
    )
    empty = (F.col("entity_extracted") == 0) & (F.col("fact_extracted") == 0)
    return scored.withColumn("noise_correctly_empty", F.col("is_noise") & empty)


def noise_rejection_rate(scored: DataFrame) -> DataFrame:
    """Share of noise records with nothing extracted; null without noise records."""
    hit = F.when(F.col("is_noise"), F.col("noise_correctly_empty").cast("double"))
    return scored.agg(F.avg(hit).alias("noise_rejection_rate"))


# -- entity resolution ------------------------------------------------------------------------


def _graph_lookup(entity_forms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lower-cased form to node: `entity_forms` has entity_id, name, alias (null for none).

    Of several nodes with one form the last in id order counts, and an alias before a name.
    """
    forms = entity_forms.select(
        *by,
        "entity_id",
        "name",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("kind"), F.col("name").alias("form")),
                F.struct(F.lit(1).alias("kind"), F.col("alias").alias("form")),
            )
        ).alias("f"),
    )
    low = F.lower("f.form").alias("_form")
    known = forms.filter(F.col("f.form").isNotNull())
    return known.groupBy(*by, low).agg(
        F.max(F.struct("entity_id", "f.kind", "name"))["name"].alias("resolved_to")
    )


def er_diagnostics(
    expected: DataFrame, entity_forms: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Per expected surface form: what it resolves to and whether that is right.

    `expected` has canonical_name and surface_form; `by` names slice columns on both sides.
    """
    lookup = _graph_lookup(entity_forms, by)
    keyed = expected.filter(F.col("surface_form").isNotNull()).withColumn(
        "_form", F.lower("surface_form")
    )
    joined = keyed.join(lookup, [*by, "_form"], "left")
    outcome = (
        F.when(F.col("resolved_to").isNull(), "not_found")
        .when(F.lower("resolved_to") == F.lower("canonical_name"), "correct")
        .otherwise("wrong")
    )
    return joined.withColumn("outcome", outcome).select(
        *by, "canonical_name", "surface_form", "resolved_to", "outcome"
    )


def er_scores(
    expected: DataFrame, entity_forms: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Node count accuracy, merge recall, entity merge rate and false merge rate, per slice."""
    by = list(by)
    diag = er_diagnostics(expected, entity_forms, by)
    actual = entity_forms.groupBy(*by).agg(F.count_distinct("entity_id").alias("node_count_actual"))
    held = entity_forms.select(
        *by, "entity_id", F.explode(F.array("name", "alias")).alias("_form")
    ).filter(F.col("_form").isNotNull())
    held = held.withColumn("_form", F.lower("_form")).distinct()
    holders = held.join(_expected_owners(expected, by), [*by, "_form"])
    per_node = holders.groupBy(*by, "entity_id").agg(
        (F.min("_canonical") < F.max("_canonical")).alias("several")
    )
    false_merges = per_node.groupBy(*by).agg(
        F.count(F.lit(1)).alias("false_merge_total"),
        F.count_if("several").alias("false_merge_count"),
    )
    return _er_totals(expected, diag, actual, false_merges, by)


def _expected_owners(expected: DataFrame, by: Sequence[str]) -> DataFrame:
    return (
        expected.filter(F.col("surface_form").isNotNull())
        .groupBy(*by, F.lower("surface_form").alias("_form"))
        .agg(F.max(F.lower("canonical_name")).alias("_canonical"))
    )


def _er_totals(
    expected: DataFrame, diag: DataFrame, actual: DataFrame, false_merges: DataFrame, by: Sequence[str]
) -> DataFrame:
    """The scores per slice from diagnostics, node counts, and counts of nodes holding expected forms."""
    by = list(by)
    per_entity = diag.groupBy(*by, "canonical_name").agg(
        F.count(F.lit(1)).alias("forms"),
        F.count_if(F.col("outcome") == "correct").alias("right"),
    )
    many = F.col("forms") > 1
    merges = per_entity.groupBy(*by).agg(
        F.sum("forms").alias("merge_recall_total"),
        F.sum("right").alias("merge_recall_correct"),
        F.count_if(many).alias("entity_merge_total"),
        F.count_if(many & (F.col("forms") == F.col("right"))).alias("entity_merge_correct"),
    )
    wanted = expected.groupBy(*by).agg(
        F.count_distinct("canonical_name").alias("node_count_expected")
    )
    # The parts are put under each other and summed per slice: no join, also when `by` is empty.
    rows = wanted
    for part in (actual, merges, false_merges):
        rows = rows.unionByName(part, allowMissingColumns=True)
    counts = [c for c in rows.columns if c not in by]
    filled = rows.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    gap = F.abs(F.col("node_count_expected") - F.col("node_count_actual"))
    return filled.select(
        *by,
        *counts,
        (1.0 - gap / F.greatest("node_count_expected", F.lit(1))).alias("node_count_accuracy"),
        ratio("merge_recall_correct", "merge_recall_total", 1.0).alias("merge_recall"),
        ratio("entity_merge_correct", "entity_merge_total", 1.0).alias("entity_merge_rate"),
        ratio("false_merge_count", "false_merge_total", 0.0).alias("false_merge_rate"),
    )


def er_timeslices(expected: DataFrame, entity_forms: DataFrame, slices: DataFrame) -> DataFrame:
    """`er_scores` of the graph as it stood at each slice.

    `slices` (slice, at) are the moments of evaluation, as many as there may be; `expected` has the
    slice of each of its rows, and `entity_forms` the moment `recorded_at` from which an entity has a
    form. No form is repeated per slice: what a form resolves to changes only when a later node takes it
    over, so an expected form looks up the latest owner before its slice, and node counts are running
    totals of the moments when entities first appeared. Slices without expected rows have scores too.
    Rows without a moment are left out, as are expected rows of a slice that `slices` does not have.
    """
    forms = entity_forms.filter(F.col("recorded_at").isNotNull()).withColumnRenamed("recorded_at", "at")
    points = slices.filter(F.col("at").isNotNull()).select("slice", "at").distinct()
    timed = expected.join(points, "slice")
    held = forms.select(
        "entity_id",
        "name",
        "at",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("kind"), F.lower("name").alias("form")),
                F.struct(F.lit(1).alias("kind"), F.lower("alias").alias("form")),
            )
        ).alias("f"),
    ).filter(F.col("f.form").isNotNull())
    owners = held.select(
        F.col("f.form").alias("_form"), "at", F.struct("entity_id", "f.kind", "name").alias("_owner")
    )
    asked = timed.filter(F.col("surface_form").isNotNull()).withColumn("_form", F.lower("surface_form"))
    # owners of a form are few and far between: a slice of moments is a year
    found = cumulative_at(asked, owners, ["_form"], "at", "_owner", "_found", grain="year")
    resolved = F.col("_found")["name"]
    outcome = (
        F.when(resolved.isNull(), "not_found")
        .when(F.lower(resolved) == F.lower("canonical_name"), "correct")
        .otherwise("wrong")
    )
    diag = found.select("slice", "canonical_name", outcome.alias("outcome"))

    births = forms.groupBy("entity_id").agg(F.min("at").alias("at")).withColumn("_one", F.lit(1).cast("long"))
    actual = cumulative_at(points, births, [], "at", "_one", "node_count_actual", total=True)

    since = held.groupBy(F.col("f.form").alias("_form"), "entity_id").agg(F.min("at").alias("_since"))
    last = timed.groupBy("slice").agg(F.max("at").alias("at"))
    wanted = _expected_owners(timed, ["slice"]).join(last, "slice")
    return _er_totals(timed, diag, actual.drop("at"), _timed_false_merges(since, wanted), ["slice"])


def _timed_false_merges(since: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per slice the nodes that hold an expected form by then, and those with forms of several entities.

    `since` (_form, entity_id, _since), `wanted` (slice, at, _form, _canonical). Many nodes may share a form that
    many slices want. So each node is counted with the one of its forms that most slices want, by a running
    total per form; only with its other forms does it meet the slices, where it is new or has several.
    """
    asked = wanted.groupBy("_form").agg(F.count(F.lit(1)).alias("_slices"))
    mine = since.join(asked, "_form")
    main = mine.groupBy("entity_id").agg(F.max(F.struct("_slices", "_form", "_since")).alias("_main"))
    entered = main.select(
        F.col("_main._form").alias("_form"), F.col("_main._since").alias("at"), F.lit(1).cast("long").alias("_one")
    )
    by_main = cumulative_at(wanted, entered, ["_form"], "at", "_one", "_n", total=True, grain="year")
    zero = F.lit(0).cast("long")
    total = by_main.select("slice", F.coalesce("_n", zero).alias("false_merge_total"), zero.alias("false_merge_count"))

    other = mine.join(main, "entity_id").filter(F.col("_form") != F.col("_main._form"))
    met = other.join(wanted, "_form").filter(F.col("_since") <= F.col("at"))
    met = met.groupBy(
        "slice", "at", "entity_id", F.col("_main._form").alias("_form"), F.col("_main._since").alias("_since")
    ).agg(F.min("_canonical").alias("_low"), F.max("_canonical").alias("_high"))
    too = wanted.select("slice", "_form", F.col("_canonical").alias("_main_canonical"))
    met = met.join(too, ["slice", "_form"], "left")
    own = F.when(F.col("_since") <= F.col("at"), F.col("_main_canonical"))
    rest = met.select(
        "slice",
        own.isNull().cast("long").alias("false_merge_total"),
        (F.least("_low", own) < F.greatest("_high", own)).cast("long").alias("false_merge_count"),
    )
    counts = [F.sum(c).alias(c) for c in ("false_merge_total", "false_merge_count")]
    return total.unionByName(rest).groupBy("slice").agg(*counts)


def resolution_accuracy(pairs: DataFrame, entity_forms: DataFrame) -> DataFrame:
    """Share of annotated pairs decided right: `merge` pairs share a node, `split` pairs do not."""
    lookup = _graph_lookup_ids(entity_forms)
    a = lookup.toDF("_a", "_node_a")
    b = lookup.toDF("_b", "_node_b")
    joined = (
        pairs.withColumns({"_a": F.lower("surface_a"), "_b": F.lower("surface_b")})
        .join(a, "_a", "left")
        .join(b, "_b", "left")
    )
    same = F.coalesce(F.col("_node_a") == F.col("_node_b"), F.lit(False))
    right = F.when(F.col("expected_outcome") == "merge", same).otherwise(~same)
    return joined.agg(
        F.avg(right.cast("double")).alias("resolution_accuracy"),
        F.count_if(right).alias("right"),
        F.count(F.lit(1)).alias("pairs"),
    )


def _graph_lookup_ids(entity_forms: DataFrame) -> DataFrame:
    forms = entity_forms.select(
        "entity_id", F.explode(F.array("name", "alias")).alias("form")
    ).filter(F.col("form").isNotNull())
    return forms.groupBy(F.lower("form").alias("form")).agg(F.max("entity_id").alias("node"))


# -- time -------------------------------------------------------------------------------------


def temporal_accuracy(assertions: DataFrame, extracted: DataFrame) -> DataFrame:
    """Share of asserted edges whose first matching fact has the right staleness and deadline.

    `assertions`: record_id, edge_label, fact_type, from_entity, stale, valid_until (text);
    `extracted`: the same and `position`, the place of a fact in its record.
    """
    keys = ["record_id", "_label", "_type", "_from"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                "_label": F.upper(text_or_empty("edge_label")),
                "_type": _low("fact_type"),
                "_from": _low("from_entity"),
            }
        )

    def day(column: str) -> Column:
        return F.left(text_or_empty(column), F.lit(10))

    first = (
        keyed(extracted)
        .groupBy(*keys)
        .agg(
            F.min_by(
                F.struct(
                    F.coalesce("stale", F.lit(False)).alias("stale"), day("valid_until").alias("day")
                ),
                "position",
            ).alias("_got")
        )
    )
    joined = keyed(assertions).join(first, keys, "left")
    stale_ok = F.coalesce("stale", F.lit(False)) == F.col("_got.stale")
    day_ok = (day("valid_until") == "") | (day("valid_until") == F.col("_got.day"))
    right = F.coalesce(stale_ok & day_ok, F.lit(False))
    return _share(joined, right)


def temporal_accuracy_by_source_day(assertions: DataFrame, extracted: DataFrame) -> DataFrame:
    """The older form: the first fact of (record, label, from) must carry the asserted event day."""
    keys = ["record_id", "_label", "_from"]
    first = (
        extracted.groupBy(
            "record_id",
            F.upper(text_or_empty("edge_label")).alias("_label"),
            _low("from_entity").alias("_from"),
        )
        .agg(F.min_by(F.struct(F.to_date("source_at").alias("day")), "position").alias("_got"))
    )
    joined = assertions.withColumns(
        {"_label": F.upper(text_or_empty("fact_category")), "_from": _low("from_entity")}
    ).join(first, keys, "left")
    right = F.col("_got").isNotNull() & F.col("valid_at").eqNullSafe(F.col("_got.day"))
    return _share(joined, right)


def _share(rows: DataFrame, right: Column) -> DataFrame:
    return rows.agg(
        F.avg(right.cast("double")).alias("temporal_accuracy"),
        F.count_if(right).alias("right"),
        F.count(F.lit(1)).alias("total"),
    )


def version_delta(runs: DataFrame) -> DataFrame:
    """Change of F1 from one engine version to the next on the same dataset version.

    `runs` has dataset_version, run_order, engine_version, f1: one row per evaluation run.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("dataset_version").orderBy("run_order")
    return runs.withColumn("delta_f1", F.col("f1") - F.lag("f1").over(w))
