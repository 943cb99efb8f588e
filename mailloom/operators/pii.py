"""Find, count, rewrite and extract personal data with a rule table.

Finding and rewriting are map-only: each rule is one pass over the text, skipped for rows
that fail the rule's cheap gate. Only overlap resolution shuffles, and it moves spans, not text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from mailloom import rules
from mailloom.config import DEFAULT_CONFIG, EngineConfig
from mailloom.functions.spans import rewrite_spans, running_sums, united
from mailloom.functions.text import bind, rewrite_hits
from mailloom.rules import PII_RULES, PiiRule
from mailloom.schemas import SPAN

#: Rules and models have a few fixed scores; each is a level of resolve_overlaps.
MOST_LEVELS = 200
_SPANS = ArrayType(SPAN)
#: Score of what a named-entity model finds, unless told otherwise.
MODEL_SCORE = 0.85
STRETCH = 1 << 18


def select_rules(entities: Sequence[str] | None = None, table: Sequence[PiiRule] = PII_RULES) -> list[PiiRule]:
    return [r for r in table if entities is None or r.entity_type in entities]


def regex_of(rule: PiiRule) -> str:
    """Word boundaries, digits and spaces are read as Unicode, on every JVM version."""
    return "(?U)" + rule.pattern


def gate(c: Column, rule: PiiRule) -> Column:
    """Whether a text may have a hit of the rule at all."""
    may = c.isNotNull()
    if rule.needs:
        may = may & c.contains(rule.needs)
    if rule.digits:
        may = may & c.rlike("[0-9]{%d}" % rule.digits)
    return may


def any_gate(c: Column, chosen: Sequence[PiiRule]) -> Column:
    """Whether any rule may hit; one look at the text decides for nearly all rows."""
    if any(not r.needs and not r.digits for r in chosen):
        return c.isNotNull()
    may = reduce(lambda acc, n: acc | c.contains(n), sorted({r.needs for r in chosen if r.needs}), F.lit(False))
    digits = [r.digits for r in chosen if not r.needs]
    return may | c.rlike("[0-9]{%d}" % min(digits)) if digits else may


def luhn_valid(c: Column) -> Column:
    """Check-digit test for card numbers."""
    return F.call_function("luhn_check", F.regexp_replace(c, "[^0-9]", ""))


def rule_spans(c: Column, rule: PiiRule, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<span> of one rule; offsets are running sums of gap and hit lengths."""
    pattern = regex_of(rule)

    def span(hit: Column, end: Column) -> Column:
        return F.struct(
            F.lit(rule.entity_type).alias("entity_type"), F.lit(rule.name).alias("rule"),
            (end - F.char_length(hit)).alias("start"), end.alias("end"), F.lit(rule.score).alias("score"), hit.alias("text"))

    def spans(hits: Column) -> Column:
        gaps = F.slice(F.split(c, pattern, -1), F.lit(1), F.size(hits))
        ends = running_sums(F.zip_with(gaps, hits, lambda gap, hit: F.char_length(gap) + F.char_length(hit)))
        return F.when(F.size(hits) > 0, F.zip_with(hits, ends, span)).otherwise(F.array().cast(_SPANS))

    found = bind(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), spans)
    if keep is not None:
        found = F.filter(found, lambda s: keep(s["text"]))
    return F.when(gate(c, rule), found).otherwise(F.array().cast(_SPANS))


def span_array(
    c: Column,
    entities: Sequence[str] | None = None,
    table: Sequence[PiiRule] = PII_RULES,
    check_cards: bool = False,
) -> Column:
    """All spans of a text, rule after rule, as one array."""
    chosen = select_rules(entities, table)
    if not chosen:
        return F.array().cast(_SPANS)
    parts = [
        rule_spans(c, r, luhn_valid if check_cards and r.entity_type == "CREDIT_CARD" else None) for r in chosen
    ]
    return F.when(any_gate(c, chosen), F.concat(*parts)).otherwise(F.array().cast(_SPANS))


def pii_spans(
    df: DataFrame,
    text: str,
    entities: Sequence[str] | None = DEFAULT_CONFIG.pii_entities,
    table: Sequence[PiiRule] = PII_RULES,
    min_score: float = DEFAULT_CONFIG.score_threshold,
    check_cards: bool = False,
) -> DataFrame:
    """One row per span: the columns of ``df`` but ``text``, then the span."""
    kept = [c for c in df.columns if c != text]
    spans = F.filter(
        span_array(F.col(text), entities, table, check_cards), lambda s: s["score"] >= min_score)
    return df.select(*kept, F.explode(spans).alias("span")).select(*kept, "span.*")


def model_spans(
    df: DataFrame,
    key: str,
    text: str,
    model: Callable[[pd.Series], pd.Series],
    score: float,
    labels: Sequence[tuple[str, str]] = rules.NER_LABELS,
) -> DataFrame:
    """Spans of a named-entity model the user supplies.

    ``model`` takes a series of texts and returns a series of lists of (label, start, end);
    labels that stand for no entity type are left out. Batches stream through each task.
    """
    kinds = dict(labels)
    schema = (
        f"{key} {df.schema[key].dataType.simpleString()}, entity_type string, rule string, "
        "start int, end int, score double, text string"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, kinds[label], "model", int(s), int(e), score, t[s:e])
                for k, t, found in zip(batch[key], batch[text], model(batch[text]))
                for label, s, e in found
                if label in kinds
            ]
            yield pd.DataFrame(rows, columns=[key, "entity_type", "rule", "start", "end", "score", "text"])

    return df.select(key, text).where(F.col(text) != "").mapInPandas(run, schema)


def apply_thresholds(
    spans: DataFrame,
    thresholds: Sequence[tuple[str, float]] = rules.ENTITY_THRESHOLDS,
    default: float = DEFAULT_CONFIG.score_threshold,
) -> DataFrame:
    """Keep spans that reach the least score of their entity type. The table is a few fixed
    values, so it is compiled into the filter."""
    return spans.where(F.col("score") >= least_scores(thresholds, default)(F.col("entity_type")))


def resolve_overlaps(
    spans: DataFrame, key: str, scores: Sequence[float] | None = None,
    stretch: int = STRETCH,
) -> DataFrame:
    """Drop each span that lies inside another one of equal or higher score.

    Sorted by start, then longer first, everything that can cover a span stands before it, so
    one running maximum of the end per score level decides: n log n, however many spans one
    text has. ``scores`` lists the levels
    that occur; by default they are read off the spans, one per rule and model.

    The work is split by stretches of each text, so one huge text is not one task: a span is
    judged in the stretch where it starts, and stands in all stretches that it touches.
    """
    first, last = (F.floor(c / stretch) for c in (F.col("start"), F.greatest(F.col("end") - 1, F.col("start"))))
    placed = spans.withColumn("_stretch", F.explode(F.sequence(first, last)))
    order = Window.partitionBy(key, "_stretch").orderBy(
        "start", F.col("end").desc(), F.col("score").desc(), "rule",
    ).rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted(set(scores)) if scores is not None else sorted(
        r["score"] for r in spans.select("score").distinct().limit(MOST_LEVELS + 1).collect())
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"over {MOST_LEVELS} different scores; round them to levels first")
    covered = reduce(
        lambda acc, level: acc | (
            (F.col("score") <= level)
            & (F.coalesce(F.max(F.when(F.col("score") >= level, F.col("end"))).over(order), F.lit(-1))
               >= F.col("end"))
        ),
        levels, F.lit(False),
    )
    judged = placed.withColumn("_covered", covered)
    return judged.where(~F.col("_covered") & (F.col("_stretch") == first)).drop("_covered", "_stretch")


def least_scores(thresholds: Sequence[tuple[str, float]], default: float) -> Callable[[Column], Column]:
    """The least score of an entity type, as an expression."""
    def least(kind: Column) -> Column:
        return F.coalesce(*[F.when(kind == name, F.lit(value)) for name, value in thresholds], F.lit(default))
    return least


def entity_spans(
    c: Column, model: Callable[[pd.Series], pd.Series], score: float = MODEL_SCORE,
    labels: Sequence[tuple[str, str]] = rules.NER_LABELS,
) -> Column:
    """array<span> of a named-entity model, as ``model_spans`` gives them row by row; batches of texts stream through it.
    Spans are cut to the text, and a null text has none."""
    kinds = dict(labels)

    @F.pandas_udf(_SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        texts = texts.fillna("")
        return pd.Series([
            [{"entity_type": kinds[label], "rule": "model", "start": max(0, int(a)), "end": min(len(t), int(b)),
              "score": score, "text": t[max(0, int(a)): int(b)]} for label, a, b in found if label in kinds]
            for t, found in zip(texts, model(texts), strict=True)], index=texts.index, dtype=object)

    return spans(c)


def _rewrite(
    c: Column, how: Callable[[Column, Column], Column], chosen: Sequence[PiiRule], extra: Column | None = None,
) -> Column:
    """Every hit put through ``how(hit, entity_type)``. All hits are looked for in the text as it came, those of
    ``extra`` (array<span>) among them; those that overlap are united, and the text is cut once.

    Where one rule hits, its hits are rewritten as they stand.
    """
    if not chosen and extra is None:
        return c

    def one(t: Column, which: Column) -> Column:
        done = F
        for i, rule in enumerate(chosen):
            done = done.when(which[i], rewrite_hits(t, regex_of(rule), lambda h, r=rule: how(h, F.lit(r.entity_type))))
        return t if done is F else done.otherwise(t)

    def several(t: Column, which: Column) -> Column:
        nothing = F.array().cast(_SPANS)
        parts = [F.when(which[i], rule_spans(t, r)).otherwise(nothing) for i, r in enumerate(chosen)]
        return rewrite_spans(t, united(F.concat(*parts, *more)), how)

    def rewritten(t: Column) -> Column:
        hits = F.array(*(F.coalesce(gate(t, r) & t.rlike(regex_of(r)), F.lit(False)) for r in chosen)).cast("array<boolean>")
        return bind(hits, lambda which: F.when(
            F.size(F.filter(which, lambda x: x)) + given > 1, several(t, which)).otherwise(one(t, which)))

    more = [] if extra is None else [F.coalesce(extra, F.array().cast(_SPANS))]
    given = F.lit(0) if extra is None else F.when(F.size(more[0]) > 0, 2).otherwise(0)
    may = (lambda t: any_gate(t, chosen)) if chosen else (lambda t: F.lit(False))
    return bind(c, lambda t: F.when(may(t) | (given > 0), rewritten(t)).otherwise(t))


def _decided(
    entities: Sequence[str] | None, table: Sequence[PiiRule], extra: Column | None,
    thresholds: Sequence[tuple[str, float]], least: float,
) -> tuple[list[PiiRule], Column | None]:
    """The rules and the further spans that entity types and thresholds let through."""
    known = dict(thresholds)
    chosen = [r for r in select_rules(entities, table) if r.score >= known.get(r.entity_type, least)]
    if extra is None:
        return chosen, None
    bound = least_scores(thresholds, least)
    return chosen, F.filter(extra, lambda s: (s["score"] >= bound(s["entity_type"])) & (
        F.lit(True) if entities is None else s["entity_type"].isin(*entities)))


def mask(
    c: Column,
    entities: Sequence[str] | None = DEFAULT_CONFIG.pii_entities,
    table: Sequence[PiiRule] = PII_RULES,
    char: str = DEFAULT_CONFIG.pii_mask_char,
    mask_plus: bool = False,
    extra: Column | None = None,
    thresholds: Sequence[tuple[str, float]] = (),
    least: float = DEFAULT_CONFIG.score_threshold,
) -> Column:
    """Overwrite every character of a hit; the length stays the same.

    ``extra`` are spans of other recognisers, such as ``entity_spans``. Spans below the least score of their entity type,
    or of other types than ``entities``, stay as they are. The phone rule as written leaves a leading "+" in place;
    ``mask_plus`` takes it too.
    """
    chosen, more = _decided(entities, table, extra, thresholds, least)
    done = _rewrite(c, lambda hit, _: F.repeat(F.lit(char), F.char_length(hit)), chosen, more)
    return F.regexp_replace(done, r"\+(?=\Q" + char + r"\E{7})", "\\" + char) if mask_plus else done


def replace(
    c: Column,
    entities: Sequence[str] | None = DEFAULT_CONFIG.pii_entities,
    table: Sequence[PiiRule] = PII_RULES,
    value: str = rules.REDACTED,
    extra: Column | None = None,
    thresholds: Sequence[tuple[str, float]] = (),
    least: float = DEFAULT_CONFIG.score_threshold,
) -> Column:
    """Put a fixed text in place of each hit; see ``mask`` for what a hit is."""
    chosen, more = _decided(entities, table, extra, thresholds, least)
    return _rewrite(c, lambda hit, _: F.when(hit.isNotNull(), F.lit(value)), chosen, more)


def hash_spans(
    c: Column,
    entities: Sequence[str] | None = DEFAULT_CONFIG.pii_entities,
    table: Sequence[PiiRule] = PII_RULES,
    extra: Column | None = None,
    thresholds: Sequence[tuple[str, float]] = (),
    least: float = DEFAULT_CONFIG.score_threshold,
) -> Column:
    """Put the SHA-256 of each hit in its place; see ``mask`` for what a hit is."""
    chosen, more = _decided(entities, table, extra, thresholds, least)
    return _rewrite(c, lambda hit, _: F.sha2(hit, 256), chosen, more)


def rewrite_by_entity(
    c: Column,
    choices: Sequence[tuple[str, str]] = rules.DEFAULT_REWRITES,
    table: Sequence[PiiRule] = PII_RULES,
    extra: Column | None = None,
    thresholds: Sequence[tuple[str, float]] = (),
    least: float = DEFAULT_CONFIG.score_threshold,
    char: str = DEFAULT_CONFIG.pii_mask_char,
    value: str = rules.REDACTED,
) -> Column:
    """Rewrite each entity type its own way: "mask", "replace" or "hash". Hits that overlap are rewritten as one, the way
    of the type with the highest score."""
    ways = {
        "mask": lambda hit: F.repeat(F.lit(char), F.char_length(hit)),
        "replace": lambda hit: F.when(hit.isNotNull(), F.lit(value)),
        "hash": lambda hit: F.sha2(hit, 256),
    }
    kinds = {way: [kind for kind, chosen in choices if chosen == way] for way in ways}

    def how(hit: Column, kind: Column) -> Column:
        done = F
        for way, names in kinds.items():
            if names:
                done = done.when(kind.isin(*names), ways[way](hit))
        return hit if done is F else done.otherwise(hit)

    chosen, more = _decided([kind for kind, _ in choices], table, extra, thresholds, least)
    return _rewrite(c, how, chosen, more)


def extract(c: Column, table: Sequence[PiiRule] = PII_RULES) -> Column:
    """struct<email, phone_number, credit_card_number> of distinct sorted values."""

    nothing = F.array().cast("array<string>")

    def values(kind: str) -> Column:
        chosen = select_rules([kind], table)
        parts = [
            F.when(gate(c, r), F.regexp_extract_all(c, F.lit(regex_of(r)), F.lit(0))).otherwise(nothing)
            for r in chosen
        ]
        return F.when(any_gate(c, chosen), F.array_sort(F.array_distinct(F.concat(*parts)))).otherwise(nothing)

    return F.struct(
        values("EMAIL_ADDRESS").alias("email"),
        values("PHONE_NUMBER").alias("phone_number"),
        values("CREDIT_CARD").alias("credit_card_number"),
    )


def pii_extract(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per distinct (key, kind, value)."""
    found = df.select(key, extract(F.col(text)).alias("data"))
    kinds = ("email", "phone_number", "credit_card_number")

    def tagged(kind: str) -> Column:
        return F.transform(F.col("data")[kind], lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    pairs = F.concat(*[tagged(k) for k in kinds])
    return found.select(key, F.explode(pairs).alias("p")).select(key, "p.*")


def pii_stats(
    df: DataFrame,
    text: str,
    by: Sequence[str] = (),
    entities: Sequence[str] | None = DEFAULT_CONFIG.pii_entities,
    table: Sequence[PiiRule] = PII_RULES,
) -> DataFrame:
    """Spans per entity type, over everything or per group; counted before the shuffle."""
    slim = df.select(*by, text)
    return (
        pii_spans(slim, text, entities, table)
        .groupBy(*by, "entity_type").agg(F.count(F.lit(1)).alias("spans"))
    )


def masked(df: DataFrame, text: str, config: EngineConfig = DEFAULT_CONFIG, alias: str | None = None) -> DataFrame:
    return df.withColumn(alias or text, mask(F.col(text), config.pii_entities, char=config.pii_mask_char))
