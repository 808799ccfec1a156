"""Claims about symbols, checked against the graph, and gates for changed symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of names that are about authentication; extensions of files that claims name.
AUTH_PARTS = ["auth", "password", "token", "permission", "role", "crypto", "encrypt", "decrypt", "verify", "jwt", "oauth", "session"]
CLAIM_EXTENSIONS = ["rs", "ts", "tsx", "py", "go", "js"]
MOST_CLAIMS, LEAST_LENGTH = 64, 3
SEVERITIES = ["info", "warning", "critical"]


def claims(text: Column) -> Column:
    """What a text claims to be about: names in backticks, then paths of files; each once, in order, MOST_CLAIMS at most."""
    quoted = F.filter(F.regexp_extract_all(text, F.lit("`([^`\n]*)`"), F.lit(1)), lambda x: x.rlike(r"^[A-Za-z0-9_:]*[A-Za-z_][A-Za-z0-9_:]*$"))
    paths = F.filter(F.split(text, r"[ \t\n\x0B\f\r`(),]"), lambda x: F.contains(x, F.lit("/")) & x.rlike(rf"^[A-Za-z0-9_/.-]+\.({'|'.join(CLAIM_EXTENSIONS)})$"))
    return F.slice(F.array_distinct(F.filter(F.concat(quoted, paths), lambda x: F.length(x) >= LEAST_LENGTH)), 1, MOST_CLAIMS)


def structured_claims(json: Column) -> Column:
    """The affected symbols and scope claims of a contract, as structs; null if it can't be read."""
    return F.from_json(json, "affected_symbols array<struct<qualified_name:string,change_kind:string,rationale:string>>, scope_claims array<struct<kind:string,assertion:string,processes:array<string>>>")


def hallucinations(claimed: DataFrame, known: DataFrame, fallback: bool = False) -> DataFrame:
    """token, severity: claims (token, change_kind) that no symbol (token) answers. What is to be modified, removed or renamed must exist."""
    missing = claimed.join(known.select("token").distinct(), "token", "left_anti")
    if fallback:
        return missing.select("token", F.lit("info").alias("severity"))
    return missing.where(F.col("change_kind").isin("modify", "remove", "rename")).select("token", F.lit("critical").alias("severity"))


def community_axis(symbols: DataFrame, by: list[str]) -> DataFrame:
    """By group: how many communities its symbols are in, and how severe that is."""
    n = F.count_distinct("community")
    return symbols.groupBy(*by).agg(n.alias("communities")).withColumn("severity", F.when(F.col("communities") >= 3, "critical").when(F.col("communities") == 2, "warning").otherwise("ok"))


def process_axis(excluded: DataFrame, taking_part: DataFrame) -> DataFrame:
    """process, symbol, severity: each symbol in a process that was to be left alone. excluded: process; taking_part: symbol, process."""
    return taking_part.join(excluded.select("process").distinct(), "process", "left_semi").select("process", "symbol", F.lit("critical").alias("severity")).distinct()


def status(findings: DataFrame) -> DataFrame:
    """One row: fail if a finding is critical, warning if one is a warning, else ok; and the counts."""
    counts = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return counts.withColumn("status", F.when(F.col("critical") > 0, "fail").when(F.col("warning") > 0, "warning").otherwise("ok"))


def gate_auth(changed: DataFrame, membership: DataFrame, names: DataFrame) -> DataFrame:
    """symbol: changed ones in a community that holds a name about authentication. membership: symbol, community; names: symbol, name."""
    about = names.where(F.lower("name").rlike("|".join(AUTH_PARTS))).select("symbol")
    critical = membership.join(about, "symbol", "left_semi").select("community").distinct()
    return membership.join(changed, "symbol", "left_semi").join(critical, "community", "left_semi").select("symbol", F.lit("S1").alias("gate"), F.lit("critical").alias("severity")).distinct()


def gate_unsafe(changed: DataFrame) -> DataFrame:
    """One note for each symbol: unsafe code isn't looked for."""
    return changed.select("symbol", F.lit("S2").alias("gate"), F.lit("info").alias("severity"))


def gate_public(changed: DataFrame, symbols: DataFrame, defined_by_file: DataFrame) -> DataFrame:
    """Changed symbols that are public and that a file itself defines."""
    public = symbols.where(F.col("visibility") == "pub").select("symbol").join(defined_by_file, "symbol", "left_semi")
    return changed.join(public, "symbol", "left_semi").select("symbol", F.lit("S3").alias("gate"), F.lit("warning").alias("severity"))


def gate_imports(unresolved: DataFrame) -> DataFrame:
    """file, gate, severity by a file's unresolved imports: two are critical, one is a warning."""
    counted = unresolved.groupBy("file").agg(F.count("*").alias("n"))
    return counted.select("file", F.lit("S4").alias("gate"), F.when(F.col("n") >= 2, "critical").otherwise("warning").alias("severity"))


def gate_tests(changed: DataFrame, participation: DataFrame, tests: DataFrame) -> DataFrame:
    """Changed symbols that no test's process takes in. participation: symbol, process; tests: process."""
    covered = participation.join(tests.select("process").distinct(), "process", "left_semi").select("symbol")
    return changed.join(covered, "symbol", "left_anti").select("symbol", F.lit("S5").alias("gate"), F.lit("warning").alias("severity"))


def report(flags: DataFrame) -> DataFrame:
    """One row: the counts by severity, and whether the gates are passed."""
    return flags.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], (F.count_if(F.col("severity") == "critical") == 0).alias("passes"))
