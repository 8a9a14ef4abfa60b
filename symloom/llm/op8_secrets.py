"""Secret scans: multipart credential linking by an interval join.

A part is an access identifier, a secret or an endpoint, found by the rules below at a place in a text. Strong parts have a form that
nothing else has and are reported by themselves; a private key is one from BEGIN to END. Weak ones (mail addresses, bare hexadecimal strings, long runs of both cases and digits, bare addresses of machines, plain
user names) are reported only if a part of another class lies in their scope, the SCOPE characters before and after them. Parts
are joined with scopes by document and cell of the text, so a document with very many parts costs no cross product.

Weak parts don't overlap each other, the first in the text counts. Each strong rule is searched on its own, so strong parts are found inside
any other part; where parts overlap, a redacted text has one spot for all of them.

Everything is built-in functions: documents without any part are dropped by one pattern right after the scan, places come
from the lengths of what lies between matches, and only parts are shuffled, never texts.

Nulls: a null text has no parts; a null doc_id is carried as null, its parts are linked within rows with the same text. Empty texts and empty tables
have no parts. Repeated rows count once. Values run to the end of their characters, whatever their length; what has no
bound repeats one class of characters or gives nothing back, so a very long text takes time in proportion. Values are reported as their length and a hash, never in clear, and kept as
hashes from the scan on. Other columns are not looked at in the query and carried in the stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.llm.store import table, written

SCOPE = 200
#: Of a key: its BEGIN and END, and what may stand between them on a line's edge where END is missing.
BEGIN, END, GAP = "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", "-----END [A-Z ]{0,20}PRIVATE KEY-----", r"(?:\\[rnt]|[\s\"'>|#*,+])*+"
#: To the END if no other BEGIN or END comes before it; else the lines of base64 with the headers before them, a short one only as the last.
KEY_BLOCK = BEGIN + r"(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+" + END + "|(?:(?:" + GAP + r"[A-Z][0-9A-Za-z-]{1,40}: [^\r\n\\]*+)*+(?:" + GAP + "[0-9A-Za-z+/]{16,}+={0,2}+)++(?:" + GAP + r"[0-9A-Za-z+/]{1,15}+={0,2}+(?![^\s\\\"'-]|[ \t]*[^\s\\\"'-]))?+)?+)"
#: Words that name a secret. A name may go on after its word (secret_access_key, tokenValue, secretkey; not secretary), up to the next word.
WORD = "(?:[Pp]assword|PASSWORD|[Pp]asswd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi_?[Kk]ey|API_KEY|[Aa]ccess_?[Kk]ey(?!_?[Ii][Dd])|ACCESS_KEY(?!_ID))"
NAME = WORD + "(?:(?=[0-9_]|[A-Z][a-z]|[Kk]ey|KEY|[Aa]ccess|ACCESS)(?:(?!" + WORD + ")[0-9A-Za-z_])++)?+"
#: A whole run of characters of base64 and names, of 20 or more, with letters of both cases and digits.
RUN = "[0-9A-Za-z+/_-]"
MIXED = f"(?<!{RUN})(?={RUN}{{20}})(?=[0-9A-Z+/_-]*+[a-z])(?=[0-9a-z+/_-]*+[A-Z])(?=[A-Za-z+/_-]*+[0-9]){RUN}++(?:={{1,2}}+(?![0-9A-Za-z+/_=-]))?+"
#: name, class, strong, pattern; of those that match at a place the first gives the weak part its name.
RULES = [
    ("key_block", "secret", True, KEY_BLOCK),
    ("cloud_key_id", "identifier", True, r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    ("forge_token", "secret", True, r"gh[opsu]_[0-9A-Za-z]{36}"),
    ("assigned_secret", "secret", True, NAME + r" ?[=:] ?['\"]?[0-9A-Za-z+/_.~-]{8,}['\"]?"),
    ("assigned_user", "identifier", False, r"(?:[Uu]ser(?:name)?|USER|[Ll]ogin|[Cc]lient_?[Ii][Dd]|[Aa]ccount) ?[=:] ?['\"]?[0-9A-Za-z+/_.@~-]{3,}['\"]?"),
    ("url", "endpoint", False, r"(?:https?|postgres|mysql|mongodb|redis|amqp|ssh|s3)://[0-9A-Za-z.:@_/~?&=%+-]{3,}"),
    ("mail", "identifier", False, r"[0-9A-Za-z._+-]{1,64}@[0-9A-Za-z-]{1,63}(?:\.[0-9A-Za-z-]{1,63}){1,8}"),
    ("machine", "endpoint", False, r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5})?"),
    ("mixed_run", "secret", False, MIXED),
    ("upper_hex", "secret", False, r"(?<![0-9A-F])(?=[0-9]*+[A-F])[0-9A-F]{32,}"),
    ("bare_hex", "secret", False, r"[0-9a-f]{32,}"),
]
#: For each rule, sets of strings: a match has one of each set. Rules that aren't here start with a cheap class of characters.
NEEDS = {
    "key_block": [["-----BEGIN"]], "cloud_key_id": [["AKIA", "ASIA"]], "forge_token": [["gho_", "ghp_", "ghs_", "ghu_"]],
    "assigned_secret": [["=", ":"], ["assword", "PASSWORD", "asswd", "ecret", "SECRET", "oken", "TOKEN", "pi_", "piK", "pik", "API_KEY", "ccess_", "ccessK", "ccessk", "ACCESS_KEY"]],
    "assigned_user": [["=", ":"], ["ser", "USER", "ogin", "lient", "ccount"]], "url": [["://"]], "mail": [["@"]],
}
#: Cheaper patterns that match wherever the rule does: a digit next to another character of a run, and the digits alone.
BEFORE = {"mixed_run": "[0-9](?:[A-Za-z+/_-]|(?<=[A-Za-z+/_-][0-9]))", "upper_hex": "[0-9A-F]{32}"}
#: Weak parts without a form of their own are searched in what the other rules leave.
BARE = ["mixed_run", "upper_hex", "bare_hex"]
ANY = "|".join(f"(?:{r[3]})" for r in RULES if r[0] not in BARE)
REST = "|".join(f"(?:{r[3]})" for r in RULES if r[0] in BARE)


def has_needs(text: Column, name: str) -> Column:
    """Whether the text has the plain strings that each match of the rule has."""
    out = F.lit(True)
    for strings in NEEDS.get(name, []):
        some = F.lit(False)
        for x in strings:
            some = some | text.contains(x)
        out = out & some
    return out


def has_part(text: Column) -> Column:
    """Whether any rule matches; a rule's pattern is tried only on texts with the plain strings that each of its matches has."""
    found = F.lit(False)
    for name, _, _, pattern in RULES:
        test = has_needs(text, name) if name in NEEDS else text.rlike(BEFORE[name]) if name in BEFORE else None
        found = found | (text.rlike(pattern) if test is None else F.when(test, text.rlike(pattern)).otherwise(False))
    return F.coalesce(found, F.lit(False))


def literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def first_rule(value: Column, bare: bool) -> Column:
    out = F.lit(None)
    for rule in [r for r in reversed(RULES) if (r[0] in BARE) == bare]:
        out = F.when(value.rlike("^(?:" + rule[3] + ")"), F.lit(rule[0])).otherwise(out)
    return out


def of_rule(name: Column, field: int) -> Column:
    out = F.lit(None)
    for rule in RULES:
        out = F.when(name == rule[0], F.lit(rule[field])).otherwise(out)
    return out


def parts(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, start, stop, value_hash, rule, kind, strong); places count characters from 0, mark is a hash of the text."""
    text = F.col("text")
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.cast("string").alias("text")).where(has_part(text))
    # all rules in one search, for the weak parts, then the bare ones where the others are blank, and each strong rule on its own: no part
    # that begins before it hides it
    blank = lambda hits: F.array_join(F.transform(F.split(text, ANY, -1), lambda x, i: F.concat(x, F.coalesce(F.repeat(F.lit(" "), F.length(F.get(hits, i))), F.lit("")))), "")
    own = own.select("*", F.regexp_extract_all(text, F.lit(ANY), 0).alias("hits")).select("doc_id", "text", F.when(text.rlike(REST), blank(F.col("hits"))).alias("left"))
    hits = lambda of, pattern, test: F.when(test, F.struct(F.regexp_extract_all(of, F.lit(pattern), 0).alias("hit"), F.transform(F.split(of, pattern, -1), F.length).alias("gap")))
    strong = [r[0] for r in RULES if r[2]]
    found = own.select("doc_id", F.xxhash64("text").alias("mark"), hits(text, ANY, F.lit(True)).alias("any"), hits(F.col("left"), REST, F.col("left").isNotNull()).alias("rest"), *[hits(text, r[3], has_needs(text, r[0])).alias(r[0]) for r in RULES if r[2]]).distinct()
    each = F.array(*[F.struct(F.lit(x).alias("search"), F.col(f"{x}.hit").alias("hit"), F.col(f"{x}.gap").alias("gap")) for x in ["any", "rest", *strong]])
    searched = found.select("doc_id", "mark", F.explode(each).alias("s")).select("doc_id", "mark", "s.*").where(F.size("hit") > 0)
    sizes = F.transform("hit", F.length)
    # where each match begins: all gaps so far and all matches before
    at = F.transform("hit", lambda x, i: F.struct(x.alias("value"), (F.aggregate(F.slice("gap", 1, i + 1), F.lit(0), lambda a, y: a + y) + F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, y: a + y)).cast("bigint").alias("start")))
    one = searched.select("doc_id", "mark", "search", F.explode(at).alias("p")).select("doc_id", "mark", "search", "p.start", (F.col("p.start") + F.length("p.value")).alias("stop"), "p.value")
    own_rule = F.when(F.col("search") == "any", first_rule(F.col("value"), False)).when(F.col("search") == "rest", first_rule(F.col("value"), True)).otherwise(F.col("search"))
    named = one.select("doc_id", "mark", "start", "stop", F.substring(F.sha2("value", 256), 1, 16).alias("value_hash"), "search", own_rule.alias("rule"))
    named = named.select("doc_id", "mark", "start", "stop", "value_hash", "search", "rule", of_rule(F.col("rule"), 1).alias("kind"), of_rule(F.col("rule"), 2).alias("strong")).where(~F.col("strong") | ~F.col("search").isin("any", "rest")).drop("search")
    return written(named, "parts")[0]  # both sides of the interval join: the texts are searched once


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The parts that are reported, with the kinds and places of what completes them."""
    cell = scope + 512  # a part and a scope are in every cell that they touch; rows hold no values, so a long part costs in proportion
    p = found.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("stop") - 1) / cell)))).alias("p")
    s = found.withColumn("cell", F.explode(F.sequence(F.floor(F.greatest(F.col("start") - scope, F.lit(0)) / cell), F.floor((F.col("stop") + scope - 1) / cell)))).alias("s")
    on = F.col("s.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("s.mark") == F.col("p.mark")) & (F.col("s.cell") == F.col("p.cell")) & (F.col("p.start") < F.col("s.stop") + scope) & (F.col("p.stop") > F.col("s.start") - scope) & (F.col("p.kind") != F.col("s.kind"))
    key = ["doc_id", "mark", "start", "stop", "value_hash", "rule", "kind", "strong"]
    both = s.join(p, on, "left").groupBy(*[F.col(f"s.{x}") for x in key]).agg(F.array_sort(F.collect_set("p.kind")).alias("with"), F.min("p.start").alias("first_with"))
    return both.where(F.col("strong") | (F.size("with") > 0))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Rows (doc_id, rule, kind, strong, start, length, value_hash, completed_by): one for each reported part."""
    return linked(parts(docs), scope).select("doc_id", "rule", "kind", "strong", "start", (F.col("stop") - F.col("start")).alias("length"), "value_hash", F.array_join("with", ",").alias("completed_by"))


def redacted(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """All rows of docs with all their columns; reported parts are replaced by their rule's name in brackets, n_chars follows.

    Documents stay whole otherwise. A text without any part goes through untouched, beside the join.
    """
    # overlapping parts are one spot, named by its first strong part, or else its first
    w = Window.partitionBy("doc_id", "mark").orderBy("start", "stop", "rule")
    apart = F.col("start") >= F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = linked(parts(docs), scope).withColumn("new", apart.cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "mark", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min(F.struct(~F.col("strong"), "start", "rule")).getField("rule").alias("rule"))
    spots = runs.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("start", "stop", "rule"))).alias("spots")).select(F.col("doc_id").alias("spot_id"), F.col("mark").alias("spot_mark"), "spots")
    names = docs.columns
    text = F.col("d.text").cast("string")
    has = has_part(text)
    d = docs.alias("d")
    hit = d.where(has).join(spots.alias("s"), F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("s.spot_id")) & (F.xxhash64(text) == F.col("s.spot_mark")), "left")
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    step = lambda a, x: F.struct(F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit("["), x["rule"], F.lit("]")).alias("out"), x["stop"].alias("at"))
    done = F.aggregate(F.col("s.spots"), begin, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    new = F.coalesce(done, text)
    kinds = dict(docs.dtypes)
    clean = hit.select(*[new.alias(c) if c == "text" else F.when(F.col("s.spots").isNull(), F.col(f"d.`{c}`")).otherwise(F.length(new)).cast(kinds[c]).alias(c) if c == "n_chars" else F.col(f"d.`{c}`").alias(c) for c in names])
    return d.where(~has).select(*[F.col(f"d.`{c}`") for c in names]).unionAll(clean)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


#: The rules as the SQL has them: bounded values and one search for all, which gives the same on the given tables.
SQL_RULES = [
    ("key_block", "secret", True, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    ("cloud_key_id", "identifier", True, r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    ("forge_token", "secret", True, r"gh[opsu]_[0-9A-Za-z]{36}"),
    ("assigned_secret", "secret", True, r"(?:[Pp]assword|PASSWORD|[Pp]asswd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi_?[Kk]ey|API_KEY) ?[=:] ?['\"]?[0-9A-Za-z+/_.~-]{8,128}['\"]?"),
    ("assigned_user", "identifier", False, r"(?:[Uu]ser(?:name)?|USER|[Ll]ogin|[Cc]lient_?[Ii][Dd]|[Aa]ccount) ?[=:] ?['\"]?[0-9A-Za-z+/_.@~-]{3,64}['\"]?"),
    ("url", "endpoint", False, r"(?:https?|postgres|mysql|mongodb|redis|amqp|ssh|s3)://[0-9A-Za-z.:@_/~?&=%+-]{3,256}"),
    ("mail", "identifier", False, r"[0-9A-Za-z._+-]{1,64}@[0-9A-Za-z-]{1,63}(?:\.[0-9A-Za-z-]{1,63}){1,8}"),
    ("machine", "endpoint", False, r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5})?"),
    ("bare_hex", "secret", False, r"[0-9a-f]{32,128}"),
]
SQL_ANY = "|".join(f"(?:{r[3]})" for r in SQL_RULES)


def case(field: int) -> str:
    value = lambda x: literal(x) if isinstance(x, str) else str(x).lower()
    return "CASE " + " ".join(f"WHEN regexp_matches(value, {literal('^(?:' + r[3] + ')')}) THEN {value(r[field])}" for r in SQL_RULES) + " END"


SQL = f"""
WITH f AS (SELECT DISTINCT doc_id, text, regexp_extract_all(text, {literal(SQL_ANY)}) AS hit, list_transform(regexp_split_to_array(text, {literal(SQL_ANY)}), lambda x: length(x)) AS gap
  FROM documents WHERE regexp_matches(text, {literal(SQL_ANY)})),
e AS (SELECT doc_id, text, hit, gap, unnest(range(1, len(hit) + 1)) AS i FROM f),
p AS (SELECT doc_id, text, hit[i] AS value, (list_sum(gap[1:i]) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM e),
r AS (SELECT *, start + length(value) AS stop, {case(0)} AS rule, {case(1)} AS kind, {case(2)} AS strong FROM p),
l AS (SELECT s.doc_id, s.rule, s.kind, s.strong, s.start, s.stop, s.value, s.text, list_sort(list_distinct(list(o.kind) FILTER (o.kind IS NOT NULL))) AS w
  FROM r s LEFT JOIN r o ON s.doc_id IS NOT DISTINCT FROM o.doc_id AND s.text = o.text AND o.start < s.stop + {SCOPE} AND o.stop > s.start - {SCOPE} AND o.kind <> s.kind
  GROUP BY s.doc_id, s.rule, s.kind, s.strong, s.start, s.stop, s.value, s.text)
SELECT doc_id, rule, kind, strong, start, stop - start AS length, substr(sha256(value), 1, 16) AS value_hash, coalesce(array_to_string(w, ','), '') AS completed_by
FROM l WHERE strong OR len(w) > 0
"""
