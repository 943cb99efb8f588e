"""Quality rules: lines labelled as content or boilerplate by a linear-chain conditional random field.

Each line of a text has features (how many words, symbols, capitals, digits, whether it repeats an earlier line, ...).
The field scores label sequences by weights of features and of label pairs; it is trained on the small labelled texts
below by gradient ascent on the log-likelihood. Viterbi decoding gives the best sequence, and the share of words
in content lines decides whether a document is kept. Documents don't depend on each other, so this is one pass of tasks
over batches; whole texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mailloom.llm.common import text_of

MIN_WORDS = 50
MOST_REPEATED = 50
#: A document is kept if at least this share of its words is in content lines.
CONTENT_SHARE = 0.5
SYMBOLS = "#*$%&|<>"
DROP_SYMBOLS = str.maketrans("", "", SYMBOLS)
DROP_DIGITS = str.maketrans("", "", "0123456789")
LEGAL = re.compile(
    r"licen[sc]ed? |copyright|©|\(c\) |all rights reserved|terms of (?:use|service)|privacy policy|spdx-|cookies? |"
    r"subscribe|sign up|log ?in|click here|share this|read more|powered by|unsubscribe|newsletter", re.I)
LINK = re.compile(r"https?://|www\.|@[a-z]", re.I)
END = tuple(".!?:;…\"”»)")
FEATURES = ("any", "one word", "two to four", "five to nine", "ten and more", "ends a sentence", "some symbols",
            "many symbols", "bars", "seen before", "capitals", "digits", "legal or menu", "link", "shouts", "few words anew")


def counts(line: str, words: list[str], seen: bool) -> tuple[float, ...]:
    """The feature values of a line with words."""
    n, chars = len(words), len(line)
    symbols = (chars - len(line.translate(DROP_SYMBOLS))) / n
    digits = chars - len(line.translate(DROP_DIGITS))
    upper = n > 2 and line.isupper()
    return (
        1, n == 1, 2 <= n <= 4, 5 <= n <= 9, n >= 10, line.rstrip().endswith(END), symbols > 0.15, symbols > 0.6,
        line.count("|") > 0.2 * n, seen, upper, digits > 0.3 * chars, LEGAL.search(line) is not None,
        LINK.search(line) is not None, line.count("!") > 0.3 * n and n > 2, n >= 8 and len(set(words)) < 0.5 * n)


class Field(NamedTuple):
    """weights: a line's score for content; pairs[a, b]: score of label a followed by b (0 boilerplate, 1 content)."""

    weights: np.ndarray
    pairs: np.ndarray

    def decode(self, rows: np.ndarray) -> list[int]:
        """The best label sequence of a text's lines, by Viterbi; ties go to content."""
        scores = (rows @ self.weights).tolist()
        (p00, p01), (p10, p11) = self.pairs.tolist()
        best0, best1, back = 0.0, scores[0], []
        for s in scores[1:]:
            a, b = best0 + p00, best1 + p10
            c, d = best0 + p01, best1 + p11
            back.append((int(b >= a), int(d >= c)))
            best0, best1 = max(a, b), max(c, d) + s
        label = int(best1 >= best0)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]

    def slope(self, rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gradient of the log-likelihood of one labelled text: observed less expected features."""
        n = len(rows)
        own = np.stack([np.zeros(n), rows @ self.weights], 1)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = own[0]
        for i in range(1, n):
            ahead[i] = own[i] + np.logaddexp.reduce(ahead[i - 1][:, None] + self.pairs, axis=0)
        for i in range(n - 2, -1, -1):
            behind[i] = np.logaddexp.reduce(self.pairs + (own[i + 1] + behind[i + 1])[None, :], axis=1)
        total = np.logaddexp.reduce(ahead[-1])
        content = np.exp(ahead[:, 1] + behind[:, 1] - total)
        pairs = np.zeros((2, 2))
        for i in range(n - 1):
            joint = ahead[i][:, None] + self.pairs + (own[i + 1] + behind[i + 1])[None, :] - total
            pairs -= np.exp(joint)
            pairs[labels[i], labels[i + 1]] += 1
        return rows.T @ (labels - content), pairs


def lines_of(text: str) -> tuple[np.ndarray, list[int], int]:
    """Feature rows and word numbers of the lines with words, and how many of them equal an earlier one."""
    rows, sizes, seen, again = [], [], set(), 0
    for line in text.split("\n"):
        words = line.encode().split()
        if words:
            before = line in seen
            again += before
            seen.add(line)
            rows.append(counts(line, words, before))
            sizes.append(len(words))
    return np.array(rows, float).reshape(-1, len(FEATURES)), sizes, again


def labelled_texts() -> list[tuple[list[str], str]]:
    """Small texts as lines, and for each line + (content) or - (boilerplate)."""
    syllables = "ta re mo li na ve so du ki per an el".split()

    def prose(n: int, start: int = 0, end: str = ".") -> str:
        words = ["".join(syllables[(start + i * k + i * i) % 12] for k in (1, 3, 5)[: 1 + (i + start) % 3]) for i in range(n)]
        return " ".join(words).capitalize() + end

    def marked(n: int, marks: str) -> str:
        return " ".join(w + marks for w in prose(n).split())

    bars = " | ".join(prose(1, i, "") for i in range(12))
    shout = " ".join(w.strip(".").upper() + "!!" for w in prose(7).split())
    loud = prose(9, 4).upper()
    menu = ["Home", "About us", "Log in", "Sign up", "Read more"]
    legal = ["Licensed under the Apache License, Version 2.0.", "Copyright 2021 Example Ltd. All rights reserved.",
             "This work is licensed under a public license.", "We use cookies to improve this site.",
             "Subscribe to our newsletter", "Click here to share this"]
    clean = [prose(n, n) for n in (14, 1, 30, 2, 9, 5, 22, 3, 60, 1)]
    same = prose(8, 5)
    return [
        (clean, "+" * 10), (clean[::-1], "+" * 10), (clean[3:8] + clean[:2], "+" * 7),
        ([prose(40)], "+"), ([prose(3, i) for i in range(9)], "+" * 9), ([prose(1, i) for i in range(8)], "+" * 8),
        ([prose(6, i, "") for i in range(6)], "+" * 6), ([prose(12, i, "") for i in range(5)], "+" * 5),
        ([prose(20), legal[0]], "+-"), ([legal[1], prose(20), prose(33, 2), legal[2]], "-++-"),
        (menu + clean[:4] + legal[3:5], "-" * 5 + "+" * 4 + "--"), (menu + legal, "-" * 11),
        ([marked(12, "###")] * 1 + [marked(20, "%%%"), marked(9, "&&&"), marked(15, "***")], "----"),
        ([marked(30, "$$$")], "-"), ([marked(4, "###"), marked(2, "$$$"), marked(25, "&&&")], "---"),
        ([prose(9)] + [marked(n, m) for n, m in ((14, "***"), (1, "$$$"), (33, "%%%"), (60, "###"), (8, "&&&"))], "+-----"),
        ([marked(n, m) for n, m in ((45, "%%%"), (17, "***"), (2, "###"), (26, "$$$"))] + [prose(11, 2)], "----+"),
        ([marked(n, m) + " end." for n, m in ((45, "###"), (17, "&&&"), (70, "$$$"), (26, "***"))], "----"),
        ([prose(9), marked(40, "%%%") + " end.", marked(6, "***") + " end."], "+--"),
        ([marked(n, "|") for n in (30, 12, 50)] + [marked(n, "<>") for n in (19, 40)], "-----"),
        ([bars, bars + " |", bars[9:]], "---"), ([prose(10), bars, bars[5:], prose(12, 3)], "+--+"), ([bars * 4], "-"),
        ([same] * 6, "+-----"), ([prose(9), same, prose(14, 3), same, same, prose(7, 8), same], "+++--+-"),
        ([prose(11, 1), prose(4, 2)] * 4, "++------"), ([shout, shout[:-9], prose(10)], "--+"), ([shout] * 4, "----"),
        ([loud, loud[4:], loud[9:]], "---"), ([prose(15), loud, prose(11, 6)], "+-+"),
        (["12 345 67 890 11", "2020 2021 2022 17", "99 12 55"], "---"),
        ([prose(9), prose(17, 2)[:-1] + " ann@mail.example.com " + prose(3), prose(12, 5)], "+++"),
        ([prose(9)[:-1] + " +1 212 555 0143 " + prose(8), prose(16, 7)], "++"),
        (["www.example.com", "https://example.com/a", prose(22), "https://example.com/b"], "--+-"),
        ([" ".join(["spam"] * 20), " ".join(["buy now"] * 9)], "--"), ([prose(25)[:-1] + " " + "x = 5 & y < 3.", prose(20, 4)], "++"),
    ]


@cache
def field(rounds: int = 300, rate: float = 0.15, penalty: float = 0.05) -> Field:
    """Weights of the largest penalised likelihood of the labelled texts, by gradient ascent with scaled steps."""
    texts = [(lines_of("\n".join(x))[0], np.array([m == "+" for m in marks], int)) for x, marks in labelled_texts()]
    found = Field(np.zeros(len(FEATURES)), np.zeros((2, 2)))
    sums = [np.full_like(x, 1e-6) for x in found]
    for _ in range(rounds):
        slopes = [found.slope(*x) for x in texts]
        steps = []
        for i, value in enumerate(found):
            slope = sum(s[i] for s in slopes) - penalty * value
            sums[i] = 0.9 * sums[i] + 0.1 * slope ** 2
            steps.append(value + rate * slope / np.sqrt(sums[i]) / (1 + _ / 60))
        found = Field(*steps)
    return found


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    pair = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1].astype(np.int64)
    window = pair[:-1] * len(numbers) + ids[2:]
    _, which, often = np.unique(window, return_inverse=True, return_counts=True)
    hit = often[which] > 1
    covered = np.zeros(len(words), bool)
    for step in range(3):
        covered[step: step + len(hit)] |= hit
    return int(covered.sum())


class Verdict(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    content_share: float


def judge(text: str) -> Verdict:
    """All figures of one text."""
    words = text.encode().split()
    n = len(words)
    rows, sizes, again = lines_of(text)
    share = 0.0
    if n:
        labels = field().decode(rows)
        share = sum(size for size, label in zip(sizes, labels, strict=True) if label) / n
    repeated = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MOST_REPEATED * n
    return Verdict(n, len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, SYMBOLS)), again, repeated,
                   failed, not failed and share >= CONTENT_SHARE, share)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and the fields of Verdict.

    A null text has no words. Repeated rows are judged each, and equal texts alike. A text without words has a content
    share of 0. An empty table gives no rows; other columns aren't looked at.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(text) for text in batch["text"].to_pylist()]
            columns = list(zip(*found, strict=True)) or [()] * len(Verdict._fields)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", *Verdict._fields])

    slim = docs.select(docs[id_col].alias("doc_id"), text_of(docs[text_col]).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(
        of, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "base_failed boolean, kept boolean, content_share double")
