"""Custom names from a table of any size.

The names run in their order, each one as a pass over the text that the rules
and the names before it have left. A text only needs the names that can occur
in it; those are found by pieces of words.

A *piece* is a longest run of word characters other than the mark ``X``. Masks
write nothing but marks and end at word boundaries, so masking a name never
makes a new piece, nor two pieces neighbours with no mark between them. A name
can therefore match, at whatever stage, only where its own pieces stand in the
text after the rules. The key of a name is its first two pieces, if no mark
stands between them, or else its first piece; a name without any piece has
no key and belongs to every text.

Names of a measured size within ``LOOKUP_BYTES`` become a hash table inside the
plan: each text looks its own keys up, and nothing is shuffled or written.
More names are joined: a bit filter of their keys drops most of the texts' keys
first, and what is shuffled are keys and hashes. A text's candidates are grouped
by a hash of the text, or by a column that its table is bucketed by. Texts that
share a hash share candidates, which is harmless: a name masks only where it
matches. No text is written anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.expressions import let, quoted, trim_blanks
from inkveil.functions.rules import Rule
from inkveil.operators import passes as P
from inkveil.operators.joins import BROADCAST_BYTES, join_lookup, table_bytes
from inkveil.operators.redact import close_with_tokens
from inkveil.sources.policies import Policy

PIECE = r"(?U)[\w&&[^X]]+"
FIRST_PAIR = r"(?U)^[\W]*([\w&&[^X]]+)[\W]+([\w&&[^X]]+)(?![\w&&[^X]])"
#: Names up to this measured size are looked up inside the plan.
LOOKUP_BYTES = 4 << 20
#: Words of 64 bits that the bit filter has at most, and those it has for each key.
FILTER_WORDS, WORDS_PER_KEY = 1 << 21, 0.25
LARGEST = (1 << 31) - 1
#: Places that the texts of one key are dealt to.
SALTS = 16


def _clean(names: DataFrame) -> DataFrame:
    """(ord, name): ``ord`` is a big integer, which a pass number follows as far as it can."""
    cleaned = names.select(F.col("ord").cast("bigint").alias("ord"), trim_blanks(F.col("name")).alias("name"))
    return cleaned.filter("name <> ''")


def _keyed(names: DataFrame) -> DataFrame:
    first = F.regexp_extract("name", PIECE, 0)
    left = F.regexp_extract("name", FIRST_PAIR, 1)
    right = F.regexp_extract("name", FIRST_PAIR, 2)
    pair = F.concat(left, F.lit(" "), right)
    return names.withColumn("__key", F.when(left != "", pair).otherwise(first))


KEYS_OF_TEXT = let(
    "w", f"regexp_extract_all(__state.text, r'{PIECE}', 0)",
    "array_distinct(concat(w, if(size(w) > 1, zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w)), (a, b) -> concat(a, ' ', b)), array())))",
)
ENTRIES = "array<struct<key:string,ord:bigint,name:string>>"
# Names in their order, as the passes take them.
LISTED = (
    "transform(array_sort(array_distinct({found})), e -> named_struct("
    f"'ord', if(e.ord IS NULL, NULL, cast(least(greatest(e.ord, -{LARGEST}), {LARGEST - P.FIRST_CUSTOM_PASS}) as int)), 'name', e.name))"
)


def _literal(rows: DataFrame, column: str, kind: str) -> str:
    """The value of a table of one row as an SQL constant, of a size that the caller has measured."""
    value = rows.select(F.to_json(F.struct(F.col(column).alias("v")))).first()[0]
    text = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"from_json('{text}', 'v {kind}').v"


def _slots(keyed: DataFrame) -> tuple[str, int]:
    """A hash table of the names as an SQL constant, and the number of its slots."""
    n = 1 << max(0, keyed.count() - 1).bit_length()
    placed = keyed.groupBy(F.pmod(F.xxhash64("__key"), F.lit(n)).alias("slot")).agg(
        F.collect_list(F.struct(F.col("__key").alias("key"), "ord", "name")).alias("entries")
    )
    every = keyed.sparkSession.range(n).select(F.col("id").alias("slot")).join(placed, "slot", "left")
    filled = F.coalesce("entries", F.array().cast(ENTRIES))
    whole = every.agg(F.array_sort(F.collect_list(F.struct("slot", filled.alias("entries")))).alias("all"))
    return _literal(whole.select(F.col("all.entries").alias("slots")), "slots", f"array<{ENTRIES}>"), n


def _looked_up(keyed: DataFrame, always: str) -> str:
    """The names of a text's keys, from a table inside the plan."""
    slots, n = _slots(keyed)
    hits = f"filter(get(slots, cast(pmod(xxhash64(k), {n}L) as int)), e -> e.key = k)"
    found = f"flatten(transform({KEYS_OF_TEXT}, k -> transform({hits}, e -> named_struct('ord', e.ord, 'name', e.name))))"
    return let("slots", slots, LISTED.format(found=f"concat({found}, {always})"))


def _filtered(words: DataFrame, keyed: DataFrame) -> DataFrame:
    """The keys that some name may have: those whose bit is set. The filter's size follows the number of keys, up to a bound."""
    n = 1 << max(6, int(keyed.count() * WORDS_PER_KEY)).bit_length()
    place = F.expr(f"cast(shiftright(__hash, 6) & {min(n, FILTER_WORDS) - 1} as int)")
    hashed = lambda df: df.withColumn("__hash", F.xxhash64("__key")).withColumn("__word", place)
    bit = F.expr("shiftleft(1L, cast(__hash & 63 as int))")
    bits = hashed(keyed.select("__key")).groupBy("__word").agg(F.bit_or(bit).alias("__bits"))
    kept = hashed(words).join(F.broadcast(bits), "__word").where("getbit(__bits, cast(__hash & 63 as int)) = 1")
    return kept.drop("__hash", "__word", "__bits")


def _candidates(state: DataFrame, keyed: DataFrame, limit: int) -> DataFrame:
    words = state.select("__row", F.explode(F.expr(KEYS_OF_TEXT)).alias("__key"))
    pairs = join_lookup(_filtered(words, keyed), keyed, "__key", "inner", limit, salts=SALTS)
    return pairs.groupBy("__row").agg(F.collect_set(F.struct("ord", "name")).alias("__found"))


def redact_names(df: DataFrame, names: DataFrame, text: str = "text",
                 policy: Policy | None = None, small: int = 0,
                 limit: int = BROADCAST_BYTES, lookup: int = LOOKUP_BYTES,
                 key: str | None = None, rules: Sequence[Rule] = ()) -> DataFrame:
    """``redact`` with custom names from a table (ord, name).

    Pass numbers of names are 16 + ord, as far as an int goes, and shift by the
    number of ``rules`` of the caller; names of equal ord run in alphabetical
    order, those of no ord before all others, and repeated rows once. ``key``
    names a column that the table is bucketed by: with many names, texts then stay
    in their buckets, where otherwise those are shuffled by their hash, and the
    rules run a second time to find the candidates. ``small`` is taken for callers
    that give it and changes nothing.
    """
    policy = policy or Policy()
    if policy.custom_names:
        raise ValueError("give the names either in the policy or as a table")
    columns = df.columns
    texts = df.filter(F.col(quoted(text)).isNotNull())
    if not policy.enabled:
        texts = texts.filter(F.lit(False))
    keyed = _keyed(_clean(names))
    within = table_bytes(keyed) <= lookup
    plain = keyed.filter("__key = ''").agg(F.collect_set(F.struct("ord", "name")).alias("always"))
    always = _literal(plain, "always", "array<struct<ord:bigint,name:string>>")
    keyed = keyed.filter("__key <> ''")

    protected = P.tokens_sql(policy.protected_tokens)

    def masked(rows: DataFrame, by: str | None) -> DataFrame:
        state = P.run_rules(P.start_state(rows, text), policy.switches(rules), rules, protected)
        if within:
            listed = state.withColumn("__listed", F.expr(f"if(__state.text IS NULL, NULL, {_looked_up(keyed, always)})"))
        else:
            # Fenced, or the conditions of the joins would be pushed down into the passes.
            state = P.close_state(state, columns).withColumn("__row", F.col(quoted(by)) if by else F.xxhash64("__state.text"))
            found = f"concat(coalesce(__found, array()), {always})"
            listed = state.join(_candidates(state, keyed, limit).hint("merge"), "__row", "left").withColumn("__listed", F.expr(LISTED.format(found=found)))
        done = P.mask_names(listed, "__listed", P.FIRST_CUSTOM_PASS + len(rules), protected)
        return close_with_tokens(done, text, columns, policy.allowlist_tokens, bool(protected)).drop(text)

    if within or key is None:
        return masked(texts, None)
    bucketed = F.col(quoted(key))
    return masked(texts.filter(bucketed.isNotNull()), key).unionByName(masked(texts.filter(bucketed.isNull()), None))
