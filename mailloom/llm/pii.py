"""Personal data: base rules, and candidates that boosted trees accept.

Every generator is a pattern. The base generators are rules whose valid matches stay. The others propose with high
recall what base rules leave out: addresses spelled out, IPv6, cards and phones in other notations. A candidate has
format features (lengths, digits, groups, check digits) and context features (words and characters around it). Boosted
trees, trained on a small labelled table of such candidates, score it; the scores are calibrated out of fold, and
each kind has a threshold that keeps precision. Candidates that overlap a base span go. Of the others the likeliest stays,
what overlaps it goes, and so on with the rest.

Cards and phones are proposed at each group of digits and with each number of groups, so proposals overlap. Positions
come from the texts between matches: a match starts where the gaps and matches before it end. Only built-in
column functions are used; the trees are column expressions.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailloom.llm import boosting
from mailloom.llm.common import stored, text_of

KINDS = ("email", "ip", "card", "phone")
LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
NEXT = r"(?:[ ]?(?:\(dot\)|\[dot\]|\{dot\})[ ]?|[ ]dot[ ]|\.)"


#: The first group of a phone. Inside a parenthesis that it doesn't close, it is proposed with and without that.
FIRST = r"(?:\([0-9]{2,6}+\)?|(?<!\()[0-9]{2,6}+\)?|(?<=\()[0-9]{2,6}+(?!\)))"


class Generator(NamedTuple):
    """What it finds, its pattern, and a cheap test of the text without which the pattern can't match."""

    kind: str
    base: bool
    pattern: str
    gate: str
    #: Matches are empty and the candidate is group 1, so that candidates can overlap.
    ahead: bool = False


#: The base patterns say what the rules say, written so that they take linear time and no deep stack: a match starts
#: at the start of a run (or where the last match ended), and nothing that can't help is tried again.
GENERATORS = (
    Generator("email", True, rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{HOST}++(?:\.{HOST}++)++", "@"),
    Generator("ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9][.][0-9]"),
    Generator("card", True, r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", "[0-9]"),
    Generator("phone", True, r"\+[0-9][ ().0-9-]+[0-9]", "[+][0-9]"),
    Generator("email", False,
              rf"(?i)(?<!{LOCAL}){LOCAL}++(?:[ ]?(?:\(at\)|\[at\]|\{{at\}}|@)[ ]?|[ ]at[ ]){HOST}++"
              rf"(?:{NEXT}{HOST}++)++", r"(?i)\(at\)|\[at\]|\{at\}| at |@"),
    Generator("ip", False, r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}"
              r"(?::[0-9A-Fa-f]{1,4}){1,6}|(?::(?::[0-9A-Fa-f]{1,4}){1,7})|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![0-9A-Za-z:]|[.][0-9])",
              "[0-9A-Fa-f]:|:[0-9A-Fa-f]"),
    *(Generator("card", False, rf"(?<![0-9A-Za-z.])(?=([0-9]{{3,12}}+(?:[ ._/-]{{1,2}}[0-9]{{2,12}}+){{{n}}})(?![0-9A-Za-z]))",
                "[0-9]{3}[ ._/-]", True) for n in (1, 2, 3, 4, 5)),
    *(Generator("phone", False, rf"(?<![0-9A-Za-z+.$#-])(?=((?:00[0-9]{{1,3}}[ .-]?(?:[0-9][ .-])?)?{FIRST}"
                rf"(?:(?:[ ./-]{{1,2}}|(?<=\)))[0-9]{{2,10}}+){{{n}}})(?![0-9A-Za-z%]))", "[0-9]{2}[ )./-]", True) for n in (1, 2, 3, 4, 5, 6)),
    Generator("phone", False, r"(?<![0-9A-Za-z+.,$#_/=:-])[0-9]{9,15}+(?![0-9A-Za-z%_/-]|[.,:][0-9])", "[0-9]{9}"),
)
CONTEXT = 40
#: Words that speak for a kind, and words that speak for other numbers.
HINTS = {
    "email": "mail|contact|write|reach", "ip": "ip|host|server|address|ping|login", "phone":
    "phone|tel|call|mobile|fax|cell|dial|whatsapp|contact|sms", "card": "card|visa|master|amex|credit|debit|payment",
    "other": "isbn|order|invoice|version|serial|ref|total|price|page|date|born|year|id|no|sku|part|chapter|room",
}


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The check digit of up to 19 digits is right. Zeros in front don't matter."""
    padded = F.lpad(number, 19, "0")
    twice = F.translate(padded, "0123456789", "0246813579")
    terms = [F.substring(padded if i % 2 else twice, i, 1).cast("int") for i in range(1, 20)]
    return reduce(lambda a, b: a + b, terms) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """A base match that isn't to be dropped."""
    number = digits(match)
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(match, "[.]"), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False))),
        "card": (F.length(number) <= 19) & luhn(number),
        "phone": F.length(number).between(9, 15),
    }[kind]


def plausible(kind: str, match: Column) -> Column:
    """A candidate worth scoring."""
    number = digits(match)
    return {
        "email": F.lit(True), "ip": F.lit(True),
        "card": F.length(number).between(13, 19),
        "phone": F.length(number).between(9, 15),
    }[kind]


def features(kind: Column, match: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context features of a candidate, as numbers."""
    number, near = digits(match), F.lower(before)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    groups = F.filter(F.split(match, "[^0-9]+"), lambda x: x != "")
    length = F.length(number)
    found = {f"is_{k}": flag(kind == k) for k in KINDS}
    found |= {f"hint_{k}": flag(near.rlike(rf"(?<![a-z])(?:{words})(?:s|nr|no)?[ .:#]*+(?:[a-z:]*[ :]*)?$"))
              for k, words in HINTS.items()}
    found |= {f"near_{k}": flag(near.rlike(rf"(?<![a-z])(?:{words})(?![a-z])")) for k, words in HINTS.items()}
    return found | {
        "length": F.length(match), "digits": length, "groups": F.size(groups),
        "first_group": F.coalesce(F.length(F.try_element_at(groups, F.lit(1))), F.lit(0)),
        "last_group": F.coalesce(F.length(F.try_element_at(groups, F.lit(-1))), F.lit(0)),
        "even_groups": flag(match.rlike(r"^(?:[0-9]{4}[^0-9]+){2,}[0-9]{1,4}$")),
        "parens": flag(match.rlike(r"^\(")), "dots": F.size(F.split(match, "[.]")) - 1,
        "slashes": flag(match.rlike("[/_]")), "luhn": flag(luhn(F.substring(number, 1, 19)) & (length >= 13)),
        "spelled": flag(match.rlike(r"(?i)[(\[{](?:at|dot)[)\]}]| dot ")), "at_sign": flag(match.contains("@")),
        "us": flag(match.rlike(r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$")),
        "abroad": flag(match.rlike("^00")), "date": flag(match.rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:$|[^0-9])")),
        "double_colon": flag(match.contains("::")), "colons": F.size(F.split(match, ":")) - 1,
        "hex_letters": flag(match.rlike("[A-Fa-f]")),
        "top_level": flag(match.rlike(r"(?i)(?:\.|dot[)\]}]?[ ]?)(?:com|net|org|edu|gov|info|io|de|fr|es|uk|eu|example)$")),
        "letter_after": flag(after.rlike(r"^[A-Za-z]")), "digit_after": flag(after.rlike(r"^[ .-]?[0-9]")),
        "digit_before": flag(before.rlike(r"[0-9][ .,-]?$")), "zero": flag(match.rlike(r"^\(?0")),
        "letters_only": flag(match.rlike("^[^0-9]*$")),
    }


def numbers(seed: int, between: str, right: bool) -> str:
    """Sixteen digits in groups of four, with a right or a wrong check digit."""
    digits_ = [4, *((seed * 7 + i * i * 3 + i) % 10 for i in range(14))]
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits_))
    whole = "".join(map(str, [*digits_, (-total + (not right)) % 10]))
    return between.join(whole[i: i + 4] for i in range(0, 16, 4))


def examples() -> list[tuple[str, str, str, str, int]]:
    """The labelled table: kind, candidate, text before, text after, label."""
    rows = []

    def add(kind: str, label: int, found: list[str], before: list[str], after: list[str]) -> None:
        for i, x in enumerate(found):
            for j, b in enumerate(before):
                rows.append((kind, x, b, after[(i + j) % len(after)], label))

    end = [" .", ", or later", "\nThanks", " and", ""]
    add("phone", 1, ["(212) 555-0143", "415-555-0199", "030 555 01 77", "0049 30 5550144", "020 7946 0958",
                     "303.555.0166", "01 55 50 12 34", "(06) 5550 1234"],
        ["Call ", "my phone is ", "Tel: ", "mobile ", "reach us by phone: ", "fax no. "], end)
    add("phone", 1, ["(212) 555-0143", "(415) 555-0188", "(303) 555-0122", "(617) 555-0107"], ["or ", "at ", "\n", ""], end)
    add("phone", 0, ["2024-10-12 10", "12 345 678 90", "100 200 300", "10.12.2024 11", "978-0-30 640-615", "2019 2020 2021",
                     "123-456-789", "1999-12-31 23", "12/11/2020 10", "555 444 333", "415-555-0199", "30 40 50 60 70"],
        ["order ", "ISBN ", "invoice no. ", "on the date ", "version ", "the values ", "serial ", "ref: ", "page ", "then "],
        end)
    # Phones next to other numbers, and what goes over the end or the start of one.
    near = [" 24 hours", " 415 555 0188", ",415-555-0188", " 2024 1000", " 7 days", "", " and"]
    add("phone", 1, ["(212) 555-0143", "415-555-0199", "212 555 0143", "303.555.0166", "617-555-0107", "720 555 0119"],
        ["Call ", "phone 212 555 0143 ", "tel 212-555-0143,", "", "or ", "numbers: 646-555-0111, "], near)
    add("phone", 0, ["415-555-0199 24", "212 555 0143 2024", "555 0143 415 555", "555 0143 415", "0143 415 555", "0188 303 555 0122",
                     "0143 2024 1000", "555-0199 24 10", "303.555.0166 30", "555 0143 2024", "0199 212 5550"],
        ["Call ", "phone 212 ", "tel 212-555-", "my number 415 555 ", ""], [" hours", " 0188", " 555 0188", " 1000", " days"])
    # Numbers in one or two pieces: the words before them decide.
    add("phone", 1, ["0301234567", "2125550143", "212 5550143", "07911 123456", "(212)555-0143", "015155501434", "(030)5550177",
                     "4155550199", "030 55501770", "0049305550144"],
        ["call me on ", "tel ", "my phone is ", "mobile ", "Phone: ", "fax no. ", "whatsapp ", "reach us by phone: "], end)
    add("phone", 1, ["(212)555-0143", "(415)555-0188", "(617)555-0107"], ["or ", "at ", "", "\n"], end)
    add("phone", 0, ["1234567890", "0301234567", "20241012101500", "9780306406157", "212 5550143", "1700000000", "48213 773112",
                     "100000 200000", "5550143555", "07911 123456", "20240101 1200"],
        ["order ", "id ", "serial ", "version ", "the values ", "ref: ", "invoice no. ", "", "and ", "total ", "page ", "of "], end)
    add("phone", 0, ["555-0143 415-555-0188", "0143 415-555-0188", "212-555-0143 415-555", "555-0188 303-555-0122", "0188 303-555",
                     "212 555 0143 415", "555 0143 415 555 0188", "555-0122 617-555-0107", "303.555.0166 303.555", "555.0166 303.555.0177"],
        ["phones 212-", "212-555-", "phones ", "415-555-0188 212-", "tel ", "303."], ["", " 303-555-0122", "-0188", "-555-0188", " now"])
    add("phone", 1, ["212-555-0143", "415-555-0188", "303-555-0122", "617-555-0107", "303.555.0166", "212 555 0143"],
        ["phones ", "212-555-0143 ", "415-555-0188 303-555-0122 ", "phones 212-555-0143 ", "call 303.555.0166 "],
        [" 415-555-0188", " 303-555-0122 617-555-0107", "", " now", " 303.555.0177"])
    add("email", 1, ["jane (at) a.b.c.d.e.f.com", "x" * 70 + " [at] mail.example.org", "ann.lee at mail dot eu dot corp dot example dot net",
                     "j" * 65 + "(at)example.com"], ["mail ", "contact: ", "", "or "], end)
    add("ip", 1, ["::1", "::ffff:a00:1", "::8a2e:370:7334", "2001:db8:85a3::", "fe80::"], ["ip ", "host ", "address: ", "server ", "ping "], end)
    add("ip", 0, ["::add", "::bad", "::1", "::face", "ab::", "::2"], ["method ", "use ", "the ", "ratio ", "verse ", "call "], end)
    add("card", 0, ["100000 20000000", "2024 10 12 10 15 30", "12345678 12345678", "555 0143 555 0144"],
        ["order ", "the values ", "ref: ", "", "total ", "and "], end)
    add("card", 1, [numbers(i, sep, True) for i, sep in enumerate(["."] * 4 + ["_"] * 3 + ["  "] * 3 + ["/"] * 3)],
        ["card ", "my Visa ", "credit card number: ", "pay with ", "payment by ", ""], end)
    add("card", 0, [numbers(i + 20, sep, False) for i, sep in enumerate([".", "_", "  ", "/"] * 2)] + [
        "2020.2021.2022.2023", "1000/2000/3000/4001"],
        ["card ", "order ", "serial ", "version ", "the values ", "ref: ", "", "total "], end)
    add("email", 1, ["jane (at) mail.example.com", "joe.doe[at]example[dot]org", "ann at corp dot example dot net",
                     "info {at} shop.de", "sales [at] firm (dot) com", "bob(at)school.edu"],
        ["mail ", "contact: ", "write to ", "", "reach me: ", "\n"], end)
    add("email", 1, ["Jane (AT) mail.example.com", "JOE.DOE[AT]EXAMPLE[DOT]ORG", "ann AT corp DOT example DOT net"],
        ["mail ", "Contact: ", ""], end)
    add("email", 0, ["look at example.com", "met at a.m", "was at version.two", "arrive at noon.Then", "shop at store.com",
                     "stay at home.We", "look @ this.one", "price @ 3.50", "x @ y.z"],
        ["we ", "they ", "please ", "", "and ", "he "], end)
    add("ip", 1, ["2001:db8:85a3:0:0:8a2e:370:7334", "fe80:0:0:0:204:61ff:fe9d:f156", "2001:db8::1",
                    "2001:db8:0:1::5", "fe80::a1:b2c3:d4e5", "2620:0:2d0:200::7", "fd12:3456:789a:1::1", "2a02:26f0:1700::b81b",
                    "fe80::1ff:fe23:4567:890a",
                  "2001:db8:1::ab9:c0a8:102"], ["ip ", "server ", "from host ", "address: ", "login from ", ""], end)
    add("ip", 0, ["1::2", "12:30::15", "a::b", "3:4::5", "9:15::20", "07:45::30",
                    "12:00:00::5"],
        ["at ", "ratio ", "the time ", "verse ", "", "call "], end)
    return rows


class Judge(NamedTuple):
    """Trees over the features, calibration, and the threshold of each kind."""

    trees: list
    a: float
    b: float
    thresholds: dict[str, float]


_judges: dict[tuple[float, int], Judge] = {}


def train(spark: SparkSession, precision: float = 0.95, folds: int = 5) -> Judge:
    """The judge of these settings; it depends on nothing else, so a process fits it once."""
    if (precision, folds) not in _judges:
        _judges[precision, folds] = fit(spark, precision, folds)
    return _judges[precision, folds]


def fit(spark: SparkSession, precision: float, folds: int) -> Judge:
    """Fit trees on the labelled table. Calibration and thresholds use margins of trees that haven't seen the row:
    rows of one candidate string are in one fold."""
    table = examples()
    literal = F.array(*[F.struct(F.lit(i).alias("i"), *(F.lit(v).alias(n) for v, n in zip(
        row[:4], ("kind", "match", "before", "after"), strict=True))) for i, row in enumerate(table)])
    frame = spark.range(1).select(F.explode(literal).alias("x")).select("x.*")
    columns = features(F.col("kind"), F.col("match"), F.col("before"), F.col("after"))
    found = frame.select("i", *(c.cast("double").alias(n) for n, c in columns.items())).orderBy("i").collect()
    rows = np.array([list(r)[1:] for r in found])
    labels, kinds = np.array([x[4] for x in table], float), np.array([x[0] for x in table])
    order = {m: k % folds for k, m in enumerate(dict.fromkeys(x[1] for x in table))}
    fold = np.array([order[x[1]] for x in table])
    margin = np.zeros(len(rows))
    for k in range(folds):
        margin[fold == k] = boosting.margins(boosting.boost(rows[fold != k], labels[fold != k]), rows[fold == k])
    a, b = boosting.platt(margin, labels)
    p = 1 / (1 + np.exp(-(a * margin + b)))
    thresholds = {}
    for kind in KINDS:
        mine, truth = p[kinds == kind], labels[kinds == kind]
        good = [t for t in np.unique(mine) if truth[mine >= t].mean() >= precision]
        thresholds[kind] = float(max(0.5, min(good, default=1.0)))
    return Judge(boosting.boost(rows, labels), a, b, thresholds)


def matches(text: Column, gate: Column, generator: Generator, number: int) -> Column:
    """All matches of a generator's pattern, in order, each with the length of the gap before it."""
    # Splitting leaves out an empty match at the start of a text, so there is a space in front of it.
    text = F.concat(F.lit(" "), text) if generator.ahead else text
    gaps = F.split(text, generator.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(generator.pattern), F.lit(int(generator.ahead)))
    rows = F.arrays_zip(found.alias("match"), gaps.alias("gap"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))
    # Gaps between empty matches have a group of two digits and a separator at least, and candidates at most CONTEXT.
    ends = F.transform(gaps, lambda x: F.right(x, F.lit(CONTEXT)))
    starts = F.transform(gaps, lambda x: F.left(x, F.lit(2 * CONTEXT)))

    def row(x: Column, i: Column) -> Column:
        match = x["match"]
        if generator.ahead:
            least = F.greatest(i + 2 - CONTEXT // 3 - 1, F.lit(1))
            before = F.right(F.array_join(F.slice(ends, least, i + 2 - least), ""), F.lit(CONTEXT))
            after = F.array_join(F.slice(starts, i + 2, F.lit(2 * CONTEXT // 3 + 1)), "")
            after = F.substring(after, F.length(match) + 1, F.lit(CONTEXT))
            step = F.lit(0)
        else:
            before, after, step = F.right(x["gap"], F.lit(CONTEXT)), F.left(x["next"], F.lit(CONTEXT)), F.length(match)
        good = valid(generator.kind, match) if generator.base else plausible(generator.kind, match)
        return F.struct(
            F.lit(number).alias("g"), i.alias("i"), (F.length(x["gap"]) - (i == 0).cast("int") * int(generator.ahead)).alias("gap"),
            step.alias("step"), F.length(match).alias("length"),
            good.alias("good"), *(
                [F.lit(None).cast("string").alias(n) for n in ("match", "before", "after")] if generator.base else
                [match.alias("match"), before.alias("before"), after.alias("after")]))

    found = F.transform(F.filter(rows, lambda x: x["match"].isNotNull()), row)
    kind = ("array<struct<g:int,i:int,gap:int,step:int,length:int,good:boolean,match:string,before:string,after:string>>")
    return F.when(gate, found.cast(kind)).otherwise(F.array().cast(kind))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has a row number and doc_id for each row of docs; spans has row, kind, start, end, base, p.

    Positions count code points, ends are exclusive. Null texts are empty ones. Texts are read whole.
    """
    text = text_of("_text")
    judge = train(docs.sparkSession)
    frame = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"))
    gates = [text.contains("@") if g.gate == "@" else text.rlike(g.gate) for g in GENERATORS]
    hits = F.concat(*(matches(text, gate, g, n) for n, (g, gate) in enumerate(zip(GENERATORS, gates, strict=True))))
    seen = stored(frame.select(F.monotonically_increasing_id().alias("row"), "doc_id", hits.alias("hits")), "hits")
    found = seen.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*")
    before = Window.partitionBy("row", "g").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("start", F.coalesce(F.sum(F.col("gap") + F.col("step")).over(before), F.lit(0))
                             + F.col("gap")).filter("good")
    kind = F.element_at(F.array(*(F.lit(g.kind) for g in GENERATORS)), F.col("g") + 1)
    base = F.element_at(F.array(*(F.lit(g.base) for g in GENERATORS)), F.col("g") + 1)
    found = found.select("row", kind.alias("kind"), base.alias("base"), "start",
                         (F.col("start") + F.col("length")).alias("end"), "match", "before", "after")
    columns = features(F.col("kind"), F.col("match"), F.col("before"), F.col("after"))
    scored = found.select("*", *(F.when(~F.col("base"), c).alias(f"f_{n}") for n, c in columns.items()))
    margin = boosting.column(judge.trees, [F.col(f"f_{n}") for n in columns])
    p = F.when(F.col("base"), F.lit(1.0)).otherwise(1 / (1 + F.exp(-(margin * judge.a + judge.b))))
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in judge.thresholds.items() for x in kv)), F.col("kind"))
    scored = scored.select("row", "kind", "base", "start", "end", p.alias("p")).withColumn("limit", limit)
    return seen.select("row", "doc_id"), resolve(scored.filter("base or p >= limit").drop("limit"))


def resolve(spans: DataFrame) -> DataFrame:
    """All base spans, and of the others that overlap no base span the likeliest, again and again, without what overlaps it.

    A run of overlapping others takes time by its size times the number of those that stay."""
    order = Window.partitionBy("row").orderBy("start", F.col("base").desc(), "end", "kind")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    coming = order.rowsBetween(1, Window.unboundedFollowing)
    end = F.max(F.when(F.col("base"), F.col("end"))).over(past)
    start = F.min(F.when(F.col("base"), F.col("start"))).over(coming)
    touched = F.coalesce(end > F.col("start"), F.lit(False)) | F.coalesce(start < F.col("end"), F.lit(False))
    kept = spans.withColumn("touched", ~F.col("base") & touched).filter("not touched")
    # A run ends where the next candidate starts at or behind the ends of all before it.
    new = F.coalesce(F.max(F.when(~F.col("base"), F.col("end"))).over(past) <= F.col("start"), F.lit(True))
    free = kept.withColumn("new", new.cast("int")).filter("not base").withColumn("run", F.sum("new").over(order))
    best = F.struct((-F.col("p")).alias("off"), (F.col("start") - F.col("end")).alias("size"), "start", "kind", "end", "p")
    runs = free.groupBy("row", "run").agg(F.array_sort(F.collect_list(best)).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))
    picked = F.aggregate("all", none, lambda done, x: F.when(
        F.exists(done, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), done).otherwise(
            F.concat(done, F.array(x))))
    picked = F.when(F.size("all") == 1, F.col("all")).otherwise(picked)
    free = runs.select("row", F.explode(picked).alias("x")).select(
        "row", "x.kind", "x.start", "x.end", F.lit(False).alias("base"), "x.p")
    return kept.filter("base").select("row", "kind", "start", "end", "base", "p").unionByName(free)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, counts of base spans by kind, base_sha256, spans, n_added.

    spans lists all spans as kind:start:end, by kind and start, joined by commas; base_sha256 is the digest of the same
    list of base spans only. A row without any has the digest of the empty text and an empty list. An empty table gives
    no rows; other columns aren't looked at.
    """
    rows, spans = find(docs, id_col, text_col)
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    at = F.struct(place.alias("place"), "start", F.concat_ws(":", "kind", "start", "end").alias("name"), "base")
    lists = spans.groupBy("row").agg(F.array_sort(F.collect_list(at)).alias("all"), *(
        F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS))
    names = lambda rows: F.array_join(F.transform(rows, lambda x: x["name"]), ",")
    lists = lists.select(
        "row", *(f"n_{k}" for k in KINDS), names(F.filter("all", lambda x: x["base"])).alias("base"),
        names("all").alias("spans"), F.size(F.filter("all", lambda x: ~x["base"])).alias("n_added"))
    out = rows.join(lists, "row", "left")
    return out.select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_added", F.lit(0)).alias("n_added"))


def redact(text: Column, spans: Column) -> Column:
    """text with each of its spans (an array of structs start, end, kind, sorted, not overlapping) as [KIND]."""
    parts = F.transform(spans, lambda x, i: F.concat(
        F.substring(text, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)) + 1,
                    x["start"] - F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))),
        F.lit("["), F.upper(x["kind"]), F.lit("]")))
    last = F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0))
    return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))
