"""Texts as numbered lines; declarative pattern rules; state carried over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exploded(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line_no from 1, line; a break at the end opens no further line."""
    whole = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n")
    parts = F.split(F.regexp_replace(whole, r"\n\z", ""), "\n")
    return texts.select(*keys, F.posexplode(parts).alias("p", "line")).select(*keys, (F.col("p") + 1).alias("line_no"), "line")


#: A rule fires on a line that has any of ``any``, and any of ``also`` (if given), and none of ``none``, and
#: whose trimmed text doesn't begin with ``comment``. Substrings are fixed values.
RULES = (
    ("PY-001", "python", "HIGH", ("os.system(", "subprocess.call("), (), (), "#"),
    ("JS-001", "javascript", "HIGH", ("eval(", "child_process.exec("), (), (), "//"),
    ("C-001", "c", "CRITICAL", ("strcpy(", "gets(", "strcat(", "sprintf("), (), (), "//"),
    ("C-002", "c", "HIGH", ("system(",), (), (), "//"),
    ("CPP-001", "cpp", "MEDIUM", ("delete ", "delete[] "), (), (), "//"),
    ("GO-001", "go", "CRITICAL", ("db.Query", "db.Exec"), ("fmt.Sprintf", "+"), (), ""),
    ("GO-002", "go", "HIGH", ("exec.Command(",), (), (), "//"),
    ("GO-003", "go", "HIGH", ("os.Open(", "ioutil.ReadFile(", "os.ReadFile("), ("req", "param", "path", "c.Query"), (), ""),
    ("GO-004", "go", "HIGH", ("http.Get(", "http.Post("), ("req", "url", "param", "id"), (), ""),
    ("JAVA-001", "java", "CRITICAL", ("Statement", "executeQuery", "createQuery", "SELECT"), ("+", "%s"), (), ""),
    ("JAVA-002", "java", "HIGH", ("Runtime.getRuntime().exec", "ProcessBuilder"), (), (), "//"),
    ("JAVA-003", "java", "CRITICAL", ("readObject(", "XMLDecoder("), (), (), "//"),
    ("JAVA-004", "java", "HIGH", ("new File(",), ("request.", "param", "path"), (), ""),
    ("JAVA-005", "java", "MEDIUM", ('Cipher.getInstance("DES', 'MessageDigest.getInstance("MD5"'), (), (), ""),
    ("PHP-001", "php", "CRITICAL", ("system(", "shell_exec(", "exec(", "passthru("), ("$_", "$user"), (), "//"),
    ("PHP-002", "php", "CRITICAL", ("include ", "require ", "include_once "), ("$_GET", "$_POST", "$_REQUEST"), (), ""),
    ("PHP-003", "php", "CRITICAL", ("unserialize(",), ("$_", "$user", "$data"), (), ""),
    ("PHP-004", "php", "HIGH", ("echo ", "print "), ("$_GET", "$_POST", "$_REQUEST"), ("htmlspecialchars", "htmlentities"), ""),
    ("RUBY-001", "ruby", "CRITICAL", ("where(", "find_by_sql("), ("#{",), (), ""),
    ("RUBY-002", "ruby", "CRITICAL", ("Marshal.load(", "YAML.load("), ("params", "input", "data"), (), ""),
    ("RUBY-003", "ruby", "CRITICAL", ("eval(",), ("params", "user", "input"), (), ""),
    ("RUST-001", "rust", "MEDIUM", ("unsafe {", "unsafe fn"), (), (), "//"),
    ("RUST-002", "rust", "HIGH", ("Command::new(",), (), (), "//"),
    ("RUST-003", "rust", "HIGH", ("File::open(", "fs::read_to_string("), ("user", "param", "path", "req"), (), ""),
)


def _any(line: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(line, F.lit(w))
    return out


def fires(line: Column, rule: tuple) -> Column:
    _, _, _, need, also, none, comment = rule
    out = _any(line, need)
    if also:
        out = out & _any(line, also)
    if none:
        out = out & ~_any(line, none)
    if comment:
        out = out & ~F.startswith(F.ltrim(line), F.lit(comment))
    return out


def pattern_findings(lines: DataFrame, rules=RULES, language: str | None = None) -> DataFrame:
    """One row per line and rule that fires. The catalog becomes one projection: a line is read once.

    ``language`` names a column that a rule's language must equal.
    """
    hits = []
    for r in rules:
        cond = fires(F.col("line"), r)
        if language:
            cond = cond & (F.col(language) == r[1])
        hits.append(F.when(cond, F.struct(F.lit(r[0]).alias("rule_id"), F.lit(r[2]).alias("severity"))))
    out = lines.withColumn("hit", F.explode(F.array_compact(F.array(*hits))))
    return out.select(*lines.columns, "hit.*")


def carried(lines: DataFrame, keys: list[str], order: str, opener: Column, name: str) -> DataFrame:
    """The last non-null ``opener`` at or before each line."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(opener, ignorenulls=True).over(w))


def segments(lines: DataFrame, keys: list[str], order: str, is_header: Column) -> DataFrame:
    """Blocks of lines from one header to the next: block number, header, joined body."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    numbered = lines.withColumn("block", F.sum(F.when(is_header, 1).otherwise(0)).over(w)).where("block > 0")
    body = F.array_sort(F.collect_list(F.struct(order, "line")))
    g = numbered.groupBy(*keys, "block").agg(body.alias("b"))
    return g.select(*keys, "block", F.col("b")[0]["line"].alias("header"), F.array_join(F.transform("b", lambda x: x["line"]), "\n").alias("body"))
