"""Rows of flattened tables by layouts that are data: one walk over a table's lines, led by rules (layout, state, test, step, column, next state). An institution adds rules, not code.

A rule applies in its state ('' is any; a walk begins in 'start') where its pattern matches the line, or with `pair` the line before and this one, joined by a line break; the first that
applies is taken. Steps: 'set' puts the pattern's groups into the columns from `column` on and clears those after; 'row' does so and gives a row; 'open' gives the row begun before,
clears all and begins another; 'add' appends the group, or the line, to a column; 'runs' cuts a line into a label and the numbers after it, a row each; 'head' makes the groups the
header; 'skip' does nothing. A row needs its layout's `needs` columns filled and, if `says` is given, its words in the columns from `says_from` on; equal rows are given once where `once`.
A layout with fewer than `least` rows gives none. Texts that are null or empty give no rows; every line is read, however long the text is.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

SLICE = 64  # texts in work at once
ROW = "layout string, row_no int, line_no int, cells array<string>, flags array<string>"
ATTACHED = ("appendix", "form", "table")


class Layout(NamedTuple):
    name: str
    header: tuple[str, ...]  # () where a rule finds it; one more name is numbered on to the widest row
    contexts: tuple[str, ...] = ()  # kinds of chunk that it is tried in; () is all
    least: int = 2
    least_lines: int = 0
    needs: tuple[int, ...] = ()
    says: str = ""
    says_from: int = 0
    once: bool = False
    numbered: str = ""
    flags: tuple[str, ...] = ()


class Rule(NamedTuple):
    layout: str
    state: str
    pattern: str
    step: str
    column: int = 0
    then: str = ""
    pair: bool = False


# Headers, words of amounts and marks of captions, codes and descriptions.
AMOUNTS = "이상|이하|미만|초과|원|만원|천원|명|점|%|년|개월|월|일"
MATTERS = "이상|이하|미만|초과|원|만원|천원|소송|계약|심판|사건|경비"
SUBJECTS = "유형|수칙|기준|항목|현황|내용|실적|평가"
END = r"(?=\n|$)"
CAPTION = rf"※|\*[^\d\n]*{END}|\(?\s*예시|<\s*[^<>\n]{{1,80}}\s*>{END}|\[(?:별표|별지)[^\]\n]*\]|.*\(\s*(?:단위|주)\s*[:：]|(?!.*(?:구분|일수|금액|비고|등급|점수|배점))[^\d\n]*기준{END}"
LABEL = rf"(?!(?:[IVXLCDM]+\.|[가-힣]\.))(?!{CAPTION})[^\d\n]{{1,18}}"
CODE = r"(?=[^\n]*\d)[0-9A-Za-z.,*\- ]{1,30}"
WORDS = rf"(?!\[|※|\*|<)(?!{CODE}{END})(?=[^\n]*[가-힣])[^\n]{{1,120}}"
NO_NUMBERS = r"\[?(?:별표|별지)|.*(?:제정|개정|신설|삭제|시행).{0,20}\d{4}\.\s*\d{1,2}\.\s*\d{1,2}|제\s*\d+\s*조"
DATES_ONLY = r"(?!.*[가-힣A-Za-z]{2}).*\d{4}\.\s*\d{1,2}\.\s*\d{1,2}.*\d{4}\.\s*\d{1,2}\.\s*\d{1,2}"
LAYOUTS = (
    Layout("dense_numeric", ("구분",), ATTACHED, least=3, numbered="수치", flags=("dense_numeric_row_reconstruction",)),
    Layout("vertical_checklist", (), ATTACHED, least_lines=6, needs=(0, 1), flags=("vertical_checklist_row",)),
    Layout("code_description", ("분류코드", "대상"), ATTACHED),
    Layout("numbered_colon", ("항목", "기준", "값"), ATTACHED, says=AMOUNTS, says_from=1, once=True),
    Layout("outline_condition", ("대항목", "세부항목", "순번", "기준"), ATTACHED, needs=(0,), says=MATTERS, says_from=3),
)
RULES = (
    Rule("dense_numeric", "", CAPTION, "skip"),
    Rule("dense_numeric", "", NO_NUMBERS, "skip"),
    Rule("dense_numeric", "", DATES_ONLY, "skip"),
    Rule("dense_numeric", "", r".*\d", "runs"),
    Rule("vertical_checklist", "start", rf"(?=.*(?:{SUBJECTS})|[^\n]*\n.*(?:{SUBJECTS})|.{{1,12}}\n)({LABEL})\n({LABEL})$", "head", then="body", pair=True),
    Rule("vertical_checklist", "", CAPTION, "skip"),
    Rule("vertical_checklist", "body", rf"({LABEL})$", "open", then="row"),
    Rule("vertical_checklist", "row", rf"({LABEL})$", "open", then="row"),
    Rule("vertical_checklist", "row", r"(.*)$", "add", 1),
    Rule("code_description", "", rf"(?P<c1>{WORDS})\n(?P<c0>{CODE})$", "row", pair=True),
    Rule("code_description", "", rf"(?P<c0>{CODE})\n(?P<c1>{WORDS})$", "row", pair=True),
    Rule("numbered_colon", "", r"(\d+|[가-힣])\.\s+([^:：]{1,120}?)\s*[:：]\s*(.{1,80})$", "row"),
    Rule("outline_condition", "", r"\d+\.\s+(.{2,80})$", "set", 0),
    Rule("outline_condition", "", r"[가-힣]\.\s+(.{2,100})$", "set", 1),
    Rule("outline_condition", "", r"\((\d+)\)\s+(.{2,140})$", "row", 2),
)


def groups_of(match: re.Match) -> list[str]:
    """The groups of a match, those named c0, c1 and so on in that order."""
    named = match.groupdict()
    found = [named[n] for n in sorted(named)] if named else match.groups()
    return [(g or "").strip() for g in found]


def number_runs(line: str) -> Iterator[list[str]]:
    """[label, number, number, ...] for each run of words that two or more numbers follow."""
    label: list[str] = []
    for numeric, words in groupby(line.split(), lambda w: bool(re.fullmatch(r"\d{1,4}", w))):
        part = list(words)
        if not numeric:
            label = part
        elif label and len(part) >= 2:
            said = " ".join(label)
            if len(said) <= 40 and not re.search(r"\d{4}\.\s*\d{1,2}\.\s*\d{1,2}", said) and re.search("[가-힣A-Za-z]", said):
                yield [said, *part]


def walked(lines: list[str], layout: Layout, rules: list[tuple[Rule, re.Pattern]]) -> tuple[list[str], list[tuple[int, list[str]]]]:
    """(header, rows with the line that each begins at) of one layout over lines that are stripped and not blank."""
    width = max(len(layout.header), 2)
    columns: list[list[str]] = [[] for _ in range(width)]
    header, rows, seen, state, before, begun = list(layout.header), [], set(), "start", "", None

    def give(at: int, cells: list[str]) -> None:
        fit = all(cells[c] for c in layout.needs) and (not layout.says or re.search(layout.says, " ".join(cells[layout.says_from :])))
        if fit and not (layout.once and tuple(cells) in seen):
            seen.add(tuple(cells))
            rows.append((at, cells))

    def close() -> None:
        if begun is not None:
            give(begun, [" ".join(c) for c in columns])

    for at, line in enumerate(lines):
        last, before = before, line
        for rule, pattern in rules:
            if rule.state not in ("", state) or (rule.pair and not last):
                continue
            found = pattern.match(f"{last}\n{line}" if rule.pair else line)
            if not found:
                continue
            values = groups_of(found)
            if rule.step == "open":
                close()
                columns, begun = [[] for _ in range(width)], at
            if rule.step in ("set", "open", "row"):
                columns[rule.column :] = [[v] for v in values] + [[] for _ in range(width - rule.column - len(values))]
            if rule.step == "row":
                give(at - rule.pair, [" ".join(c) for c in columns])
            elif rule.step == "add":
                columns[rule.column].append(values[0] if values else line)
            elif rule.step == "runs":
                rows.extend((at, cells) for cells in number_runs(line))
            elif rule.step == "head":
                header = values
            if rule.pair:
                before = ""  # both lines are used
            state = rule.then or state
            break
    close()
    if layout.numbered and rows:
        header += [f"{layout.numbered}{i}" for i in range(1, max(len(r) for _, r in rows))]
    return (header, rows) if len(rows) >= layout.least else ([], [])


def checked_rules(layouts: Iterable[Layout], rules: Iterable[Rule]) -> list[tuple[Layout, list[tuple[Rule, re.Pattern]]]]:
    """Layouts with their compiled rules; a rule of no layout, an unknown step or a column that is not there is refused."""
    layouts, rules = list(layouts), list(rules)
    width = {x.name: max(len(x.header), 2) for x in layouts}
    for r in rules:
        if r.layout not in width:
            raise ValueError(f"no layout {r.layout}")
        if r.step not in ("set", "row", "open", "add", "runs", "head", "skip"):
            raise ValueError(f"unknown step {r.step}")
        reach = r.column + (re.compile(r.pattern).groups if r.step in ("set", "row", "open", "head") else 1)
        if not 0 <= r.column < reach <= width[r.layout] and r.step not in ("skip", "runs"):
            raise ValueError(f"columns {r.column} to {reach} of {r.layout}")
    return [(x, [(r, re.compile(r.pattern)) for r in rules if r.layout == x.name]) for x in layouts]


def layout_rows(tables: DataFrame, key: str, text: str, context: str, layouts: Iterable[Layout] = LAYOUTS, rules: Iterable[Rule] = RULES) -> DataFrame:
    """(key, layout, row_no, line_no, cells, flags) for every table and layout that fits: row 0 is the header (line_no -1). No shuffle: each text is walked where it is read."""
    known = checked_rules(layouts, rules)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), SLICE):
                out = []
                for k, body, kind in pdf.iloc[start : start + SLICE].itertuples(index=False):
                    lines = [x.strip() for x in (body or "").split("\n") if x.strip()]
                    for layout, tests in known:
                        if (layout.contexts and kind not in layout.contexts) or len(lines) < layout.least_lines:
                            continue
                        header, rows = walked(lines, layout, tests)
                        if rows:
                            out.append((k, layout.name, 0, -1, header, list(layout.flags)))
                            out.extend((k, layout.name, i, at, cells, list(layout.flags)) for i, (at, cells) in enumerate(rows, 1))
                yield pd.DataFrame(out, columns=[key, *[c.split()[0] for c in ROW.split(", ")]])

    source = tables.select(key, text, context)
    return source.mapInPandas(walk, f"`{key}` {source.schema[0].dataType.simpleString()}, {ROW}")
