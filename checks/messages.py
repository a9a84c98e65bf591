"""A table of short messages that holds every entity, derived from ``orders``.

The driver tables hold no social security number, URL token, IBAN, passport or
name in a letter, so the checks derive them. The text below is valid in Spark
SQL and in DuckDB; each order gives one message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.sources.tables import spread


def _digits(key: str, n: int, factor: int = 1) -> str:
    return f"lpad(cast(({key} * {factor}) % {10 ** n} as string), {n}, '0')"


def _pick(words: str, key: str) -> str:
    n = len(words.split(","))
    return f"split_part('{words}', ',', cast(1 + {key} % {n} as int))"


_K, _C = "o_orderkey", "o_custkey"
_FIRST = _pick("Alice,Bruno,Chloe,Dmitri,Elena,Farid,Grace,Hugo,Irene,Jonas,Kim", _K)
_LAST = _pick("Keller,Smith,Garcia,Novak,Rossi,Okafor,Larsen", _C)
_STREET = _pick("Evergreen,Old Mill,St. Anne,Maple-Leaf,Kings Cross", _K)
_TYPE = _pick("Street,avenue,Rd,Boulevard,Dr,Lane,WAY,Court,Place,Terrace,hwy", _C)
_HELLO = _pick("Dear,Hello,hi,HEY,Good morning,good evening", _C)
_BYE = _pick("Best,Thanks,Thank you,Regards,Sincerely,Cheers,Kind regards,Yours truly", _C)
_LABEL = _pick("Password: ,pin:,CVV = ,api_key=,Auth Token: ,routing-number : ,d.o.b.: ,secret=x:", _C)
_URL = _pick("access_token,session,sig,code,refresh_token,monkey,lang", _K)
_PASS = _pick("Passport number: ,passport no ,PASSPORT #,passport=,Passport control ", _C)
_IBAN = _pick("DE,FR,GB,NL", _C)
_NL = "chr(10)"

# One sentence per kind; a kind is the order key modulo 16.
KINDS = [
    f"'Receipt went to ' || lower({_FIRST}) || '.' || lower({_LAST}) || '+' || {_K} || '@mail.example.com and ' || lower({_LAST}) || '@shop.example.org'",
    f"'Call me at +' || (1 + {_C} % 98) || ' ' || {_digits(_K, 3, 7)} || '-' || {_digits(_C, 3, 3)} || '-' || {_digits(_K, 4, 11)} || ' after six'",
    f"'Office: (' || {_digits(_K, 3, 7)} || ') ' || {_digits(_C, 3, 3)} || '-' || {_digits(_K, 4, 11)} || ', ask for ' || {_FIRST}",
    f"'Mobile ' || {_digits(_K, 3, 7)} || '-' || {_digits(_C, 3, 3)} || ' ' || {_digits(_K, 4, 11)} || ' or not at all'",
    f"'Fax: ' || {_digits(_K, 3, 7)} || '.' || {_digits(_C, 3, 3)} || '.' || {_digits(_K, 4, 11)}",
    f"'Deliver to ' || (1 + {_K} % 9999) || ' ' || {_STREET} || ' ' || {_TYPE} || ' before noon, please ring twice'",
    f"'Track it at https://shop.example.com/orders/' || {_K} || '?' || {_URL} || '=' || {_digits(_K, 6, 13)} || 'z&page=1 or http://example.org/key=' || {_C}",
    f"'Charged card 4' || {_digits(_K, 3, 7)} || ' ' || {_digits(_C, 4, 3)} || ' ' || {_digits(_K, 4, 11)} || ' ' || {_digits(_C, 4, 17)} || ', account ' || {_digits(_K, 12, 1000003)}",
    f"'SSN on file is ' || {_digits(_K, 3, 7)} || '-' || {_digits(_C, 2)} || ' ' || {_digits(_K, 4, 11)} || '.'",
    f"'Note the ' || {_LABEL} || 'v' || {_digits(_K, 5, 13)} || ' for later; token=abc' || {_C}",
    f"'Ordered on ' || cast(cast(o_orderdate as date) as string) || ' and due ' || (1 + {_K} % 28) || '/' || (1 + {_C} % 12) || '/1999, at ' || cast(cast(o_orderdate as date) as string) || ' 10:30'",
    f"{_HELLO} || ' ' || {_FIRST} || ' ' || {_LAST} || ',' || {_NL} || {_NL} || 'your parcel ' || {_K} || ' is on its way.' || {_NL} || {_NL} || {_BYE} || ',' || {_NL} || {_LAST}",
    f"'Login from ' || ({_K} % 256) || '.' || ({_C} % 256) || '.' || (100 + {_K} % 150) || '.' || ({_C} % 300) || ' and 192.168.1.' || (100 + {_K} % 100)",
    f"'Pay to ' || {_IBAN} || {_digits(_K, 2)} || ' NWBK ' || {_digits(_C, 4, 3)} || ' ' || {_digits(_K, 4, 11)} || ' 9268 19 or DE' || {_digits(_K, 2, 3)} || '3704' || {_digits(_C, 4, 7)} || '0532013000'",
    f"{_PASS} || 'AB' || {_digits(_K, 7, 31)} || ' was checked at the gate'",
    f"'Customer#' || lpad(cast({_C} as string), 9, '0') || ' has no secret to hide, unlike Customer#' || lpad(cast(({_C} + 7) % 1000 as string), 9, '0') || ' and ' || {_FIRST}",
]


def messages_sql(orders: str = "orders") -> str:
    cases = " ".join(f"WHEN {i} THEN {text}" for i, text in enumerate(KINDS))
    return (
        f"SELECT {_K} AS msg_id, {_C} AS cust_id, o_orderpriority AS priority, "
        f"o_orderdate AS ts, CASE {_K} % {len(KINDS)} {cases} END AS text FROM {orders}"
    )


def messages(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """The messages of a table or stream of orders.

    Orders come in few row groups, and a message takes far longer to redact than
    its order to move: so orders, not messages, are dealt to all tasks. The text is
    generated, or a filter on it would build it once more, before they are dealt.
    """
    dealt = spread(orders, _K, _C, "o_orderdate")
    made = spark.sql(messages_sql("{orders}"), orders=dealt)
    return made.select(*made.columns[:-1], F.explode(F.array("text")).alias("text"))
