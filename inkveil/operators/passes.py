"""The pass primitive and the sequence of passes.

A pass finds all matches of a rule in the text that the earlier passes have
left, masks each one and keeps a record of it. The column ``__state`` holds

* ``text``: the current text,
* ``found``: one record per match, in order of discovery,
* ``end``: where the last match ended, in bytes.

Records hold their end position as a difference to the record before
(``step``), which makes each pass linear; ``expressions.SPANS`` turns the
differences into positions when a caller asks for them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.expressions import let, quoted, raw
from inkveil.functions.masks import MARK, MASK_SQL
from inkveil.functions.patterns import NUMBERS
from inkveil.functions.rules import RULES, Rule

FOUND_TYPE = "array<struct<pass:int,entity:string,step:int,size:int>>"
NAMES_TYPE = "array<struct<ord:int,name:string>>"
CUT = "\ue000"
#: The characters that Unicode counts as white space.
BLANKS = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Names of a constant list that are passes of their own; the plan of a longer list would grow with it.
FEW_NAMES = 32
FIRST_CUSTOM_PASS = len(RULES) + 1


def _ready(rule: Rule, switch: bool | str) -> str:
    """When it is worth looking for the rule: necessary conditions only."""
    conditions = [] if switch is True else [str(switch)]
    conditions.append("__state.text IS NOT NULL")
    if rule.shape:
        conditions.append(f"__numbers RLIKE {raw(rule.shape)}")
    for literals in rule.needs:
        tests = (f"contains(__state.text, '{part}')" for part in literals)
        conditions.append("(" + " OR ".join(tests) + ")")
    if rule.hint:
        conditions.append(f"__state.text RLIKE {raw(rule.hint)}")
    return " AND ".join(conditions)


def _gaps(text: str, pattern: str, group: int = 0) -> str:
    """The text between the masked parts: one more than there are hits.

    The masked parts give way to one character, and the text is split there:
    unlike ``split`` with a pattern, that compiles the pattern once per task.
    A text that holds the character already is split by the pattern.
    """
    kept = "$1" if group else ""
    cut = f"split(regexp_replace({text}, {pattern}, '{kept}{CUT}'), '{CUT}', -1)"
    split = f"split({text}, {pattern}, -1)"
    if group:
        heads = f"regexp_extract_all({text}, {pattern}, 1)"
        split = f"zip_with({split}, {heads}, (gap, head) -> concat(gap, coalesce(head, '')))"
    return f"if(contains({text}, '{CUT}'), {split}, {cut})"


def _rewritten(state: str, number: str, entity: str, mask: str, protected: str = "") -> str:
    """The state after a pass that has ``hits`` with ``gaps`` around them.

    A hit that is one of the ``protected`` tokens, an expression, stays as it is;
    blanks around it do not count, as some patterns take one along. Its record,
    of pass 0, only carries the position on to the next one.
    """
    masked = MASK_SQL[mask]("hit")
    if protected:
        is_token = rf"array_contains({protected}, regexp_replace(hit, r'(?U)^\s+|\s+\z', ''))"
        masked = f"if({is_token}, hit, {masked})"
        number = f"if({is_token}, 0, {number})"
    woven = (
        "array_join(zip_with(gaps, hits, (gap, hit) -> "
        f"concat(gap, coalesce({masked}, ''))), '')"
    )
    records = (
        f"transform(hits, (hit, i) -> named_struct('pass', {number}, 'entity', '{entity}', "
        f"'step', octet_length(get(gaps, i)) + octet_length(hit) - if(i = 0, {state}.end, 0), "
        "'size', octet_length(hit)))"
    )
    last_end = f"octet_length({state}.text) - octet_length(element_at(gaps, -1))"
    return (
        f"named_struct('text', {woven}, 'found', concat({state}.found, {records}), "
        f"'end', {last_end})"
    )


def _pass(state: str, ready: str, find: str, gaps: str, rewritten: str) -> str:
    some = let("gaps", gaps, rewritten)
    return (
        f"CASE WHEN {ready} THEN "
        + let("hits", find, f"if(size(hits) > 0, {some}, {state})")
        + f" ELSE {state} END"
    )


def start_state(df: DataFrame, text: str) -> DataFrame:
    if df.sparkSession.conf.get("spark.sql.parser.escapedStringLiterals") == "true":
        # The patterns are raw SQL literals, which that setting turns off.
        raise ValueError("spark.sql.parser.escapedStringLiterals must be false")
    # No mask writes a digit, so the stretches of numbers in the input hold for
    # all passes.
    return df.withColumns({"__state": fresh_state(text), "__numbers": F.expr(numbers_of(text))})


def fresh_state(text: str) -> Column:
    return F.struct(
        F.col(quoted(text)).alias("text"), F.array().cast(FOUND_TYPE).alias("found"), F.lit(0).alias("end")
    )


def numbers_of(text: str) -> str:
    return f"array_join(regexp_extract_all({quoted(text)}, {raw(NUMBERS)}, 0), 'x')"


def run_rules(df: DataFrame, switches: Mapping[str, bool | str], own: Sequence[Rule] = (),
              protected: str = "") -> DataFrame:
    """The 16 passes, then those of the caller's ``own`` rules. A switch is a
    constant or a boolean SQL expression; one that is False leaves its passes
    out of the plan. ``protected`` is an expression of tokens that stay."""
    for number, rule in enumerate((*RULES, *own), start=1):
        switch = switches[rule.toggle]
        if switch is False:
            continue
        # One projection per pass: each text is rewritten once, however often
        # the passes after it look at it.
        df = df.withColumn("__state", F.expr(_pass(
            "__state",
            _ready(rule, switch),
            f"regexp_extract_all(__state.text, {raw(rule.pattern)}, {rule.group})",
            _gaps("__state.text", raw(rule.pattern), rule.group),
            _rewritten("__state", str(number), rule.entity, rule.mask, protected),
        )))
    return df.drop("__numbers")


def numbered_names(names: str) -> str:
    """A list of names as ``NAMES_TYPE``: trimmed, without blank ones."""
    trimmed = rf"transform({names}, n -> regexp_replace(n, r'(?U)^\s+|\s+\z', ''))"
    return (
        f"transform(filter({trimmed}, n -> n <> ''), "
        "(n, i) -> named_struct('ord', i + 1, 'name', n))"
    )


def mask_names(df: DataFrame, names: str, first: int = FIRST_CUSTOM_PASS, protected: str = "") -> DataFrame:
    """Mask the names of an expression of ``NAMES_TYPE`` one after the other,
    each as a pass of its own, numbered from ``first`` on by ``ord``. The work
    of a name starts with a plain search."""
    quoted = r"concat(r'\Q', replace(n.name, r'\E', r'\E\\E\Q'), r'\E')"
    pattern = rf"concat(r'(?U)\b', {quoted}, r'\b')"
    step = _pass(
        "s",
        "contains(s.text, n.name)",
        f"regexp_extract_all(s.text, {pattern}, 0)",
        _gaps("s.text", pattern),
        _rewritten("s", f"n.ord + {first - 1}", "name", "name", protected),
    )
    folded = (
        "CASE WHEN size(__names) > 0 AND __state.text IS NOT NULL "
        f"THEN aggregate(__names, __state, (s, n) -> {step}) ELSE __state END"
    )
    return (
        df.withColumn("__names", F.expr(names))
        .withColumn("__state", F.expr(folded))
        .drop("__names")
    )


def string_sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tokens_sql(tokens: Sequence[str]) -> str:
    """A constant list of tokens as SQL, or nothing if there are none."""
    listed = ", ".join(map(string_sql, tokens))
    return f"array({listed})" if listed else ""


def mask_name_list(df: DataFrame, names: Sequence[str], first: int, protected: str = "") -> DataFrame:
    """``mask_names`` for a short constant list: each name is a pass with a
    constant pattern, which a task compiles once and not once a text."""
    trimmed = (n.strip(BLANKS) for n in names)
    for number, name in enumerate((n for n in trimmed if n), start=first):
        pattern = string_sql(r"(?U)\b\Q" + name.replace(r"\E", r"\E\\E\Q") + r"\E\b")
        df = df.withColumn("__state", F.expr(_pass(
            "__state",
            f"contains(__state.text, {string_sql(name)})",
            f"regexp_extract_all(__state.text, {pattern}, 0)",
            _gaps("__state.text", pattern),
            _rewritten("__state", str(number), "name", "name", protected),
        )))
    return df


def restored(text: str, tokens: str) -> Column:
    """Put each token back over every run of marks of its length, in order.

    This is un-masking by length: a token of four characters also takes the
    place of every other run of four marks.
    """
    return F.expr(
        f"aggregate(filter({tokens}, tok -> tok <> ''), {text}, "
        f"(t, tok) -> replace(t, repeat('{MARK}', char_length(tok)), tok))"
    )


def close_state(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fence the passes off from the plan above.

    A filter on a result column would otherwise be pushed through every pass
    and copy each expression on its way. Generated columns stop that; filters
    on the other columns still reach the scan.
    """
    kept = [F.col(quoted(c)) for c in columns]
    return df.select(*kept, F.explode(F.array("__state")).alias("__state"))
