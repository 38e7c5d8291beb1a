"""What URLs and SQL text in records look like, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.checks import address_kind, dotted_quad, odd_address
from tessera.rules import fixed

VERBS = r"select|insert|update|delete|drop|truncate|alter|create|grant|revoke|merge|replace|exec|execute|call|with"


def with_url_shape(df: DataFrame, url: str = "url") -> DataFrame:
    """df with scheme, host and address (link_local, loopback, private or public) of a URL.

    A value with white space is no URL; one without a scheme is if it is an address. Hosts
    that are not plain dotted addresses but could be spelled-out ones reach a Python function; others do not.
    """
    trimmed = F.trim(url)
    u = F.when(~trimmed.rlike(r"\s"), trimmed)
    scheme = F.lower(F.nullif(F.regexp_extract(u, fixed.URL_SCHEME, 1), F.lit("")))
    bare = u.rlike(r"^[0-9a-fA-Fx:.\[\]]{3,45}(?::\d{1,5})?(?:[/?#]|$)") & u.rlike(r"[.:]")
    authority = F.when(u.rlike(r"(?i)^[a-z][a-z0-9+.\-]{0,31}://"), F.regexp_extract(u, r"(?i)^[a-z][a-z0-9+.\-]{0,31}://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)).when(bare, F.regexp_extract(u, r"^(\[[^\]]*\]|[0-9a-fA-FxX.]+)", 1))
    host = F.lower(F.nullif(authority, F.lit("")))
    df = df.withColumns({"scheme": F.when(host.isNotNull() & bare & ~u.rlike("://"), F.lit(None)).otherwise(scheme), "host": host})
    plain = dotted_quad(F.col("host"))
    odd = F.col("host").rlike(r"^(?:0x[0-9a-f]+|\d+)(?:\.(?:0x[0-9a-f]+|\d+)){0,3}$|^\[[0-9a-f:.]+\]$")
    number = F.coalesce(plain, odd_address(F.when(plain.isNull() & odd, F.col("host"))))
    return df.withColumn("address", F.coalesce(F.when(F.col("host") == "localhost", "loopback"), address_kind(number)))


#: Comments outside quotes; what stands in quotes is kept as it is. All loops are possessive, so a long text costs no stack.
_COMMENT = r"(?s)('[^']*+'|\"[^\"]*+\")|/\*.*?\*/|(?:--|#)[^\n]*+"
#: A statement: all up to a semicolon that does not stand in single quotes.
_STATEMENT = r"(?s)(?:[^;']++|'[^']*+'|')++"


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, _COMMENT, "$1 ")


def sql_statements(text: Column) -> Column:
    """All statements of a SQL text, comments and literals in double quotes aside; ends inside single quotes do not part."""
    plain = F.regexp_replace(without_comments(text), r'"[^"\n]*+"', '""')
    parts = F.regexp_extract_all(plain, F.lit(_STATEMENT), F.lit(0))
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


#: Conditions that hold of every row: a literal equal to itself, a column equal to itself, true.
TAUTOLOGY = r"(?i)\bwhere\s+1\s*$|\bwhere\b.*?(?:\b(\d+)\s*=\s*\1\b|'([^']*)'\s*=\s*'\2'|\b([a-z_][\w.]*)\s*=\s*\3\b(?!\s*\.)|\btrue\b|\bor\s+1\s*$)"


def sql_shape(statement: Column) -> Column:
    """struct<statement, object_kind, object, predicate>: the verb, what it is done to, and whether a condition bounds
    it (none, bounded or tautology). Null where the text does not begin as a statement."""
    verb = F.lower(F.regexp_extract(statement, rf"(?i)^[\s(]*({VERBS})\b", 1))
    kind = F.lower(F.nullif(F.regexp_extract(statement, "(?i)" + fixed.SQL_OBJECT_KIND, 1), F.lit("")))
    target = F.nullif(F.regexp_extract(statement, "(?i)" + fixed.SQL_OBJECT, 1), F.lit(""))
    predicate = F.when(~statement.rlike(r"(?i)\bwhere\b"), "none").when(statement.rlike(TAUTOLOGY), "tautology").otherwise("bounded")
    follows = statement.rlike(r"(?i)^[\s(]*(?:select\b.*\bfrom\b|select\s+[\w*'(]|insert\s+into\b|update\s+\S+\s+set\b|delete\s+from\b|(?:drop|truncate|alter|create)\s+\w+|grant\s+.+\s+(?:on|to)\b|revoke\s+.+\s+(?:on|from)\b|merge\s+into\b|replace\s+into\b|exec(?:ute)?\s+\w+|call\s+\w+|with\s+\w+\s+as\b)")
    return F.when((verb != "") & follows, F.struct(verb.alias("statement"), kind.alias("object_kind"), target.alias("object"), predicate.alias("predicate"), F.substring(statement, 1, 200).alias("raw")))


def sql_shapes(text: Column) -> Column:
    """Shapes of all statements of a text that holds a verb of SQL and does not begin as a shell command; else an empty array."""
    plain = without_comments(text)
    sql = F.when(plain.rlike(rf"(?i)\b(?:{VERBS})\b") & ~plain.rlike(r"^\s*(?:-{1,2}[a-zA-Z]|[/~.]|\$|[A-Za-z_]\w*=)"), text)
    return F.coalesce(F.filter(F.transform(sql_statements(sql), sql_shape), lambda x: x.isNotNull()), F.array().cast("array<struct<statement:string,object_kind:string,object:string,predicate:string,raw:string>>"))
