"""Triples (s, p, o, kind_o, datatype, language, graph, inferred): patterns, a small SPARQL, RDFS, shapes.

Subjects and predicates are IRIs; an object is an "iri" or a "literal".
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import scalars as S
from loamgraph.sources.store import cut

SCHEMA = "s string, p string, o string, kind_o string, datatype string, language string, graph string, inferred boolean"
RDF, RDFS, SH = S.NAMESPACES["rdf"], S.NAMESPACES["rdfs"], "http://www.w3.org/ns/shacl#"
TYPE, SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE = RDF + "type", RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"


def triple(s, p, o, kind: str = "iri", datatype=None, language=None, graph=None, inferred: bool = False) -> tuple:
    return (s.strip("<>"), p.strip("<>"), o.strip("<>") if kind == "iri" else o, kind, datatype, language, graph, inferred)


def make(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def with_id(t: DataFrame) -> DataFrame:
    return t.withColumn("id", S.triple_id(F.col("s"), F.col("p"), F.col("o")))


def upsert(t: DataFrame, new: DataFrame) -> DataFrame:
    """Triples of equal (s, p, o) are one; datatype and language don't tell them apart.  Of several new ones
    the last by the column `position` counts, where there is one."""
    if "position" in new.columns:
        new = new.groupBy("s", "p", "o").agg(F.max_by(F.struct(*t.columns), "position").alias("_row")).select("_row.*")
    return t.join(new.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select(*t.columns).unionByName(new.dropDuplicates(["s", "p", "o"]).select(*t.columns))


def delete(t: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Without the triples that match."""
    gone = match(t, s, p, o).select("s", "p", "o").distinct()
    return t.join(gone, ["s", "p", "o"], "left_anti").select(*t.columns)


def count(t: DataFrame) -> DataFrame:
    return t.select("s", "p", "o").distinct().agg(F.count("*").alias("count"))


def match(t: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, kind: str | None = None, graph: str | None = None, inferred: bool | None = None, limit: int | None = None) -> DataFrame:
    for name, value in (("s", s), ("p", p), ("o", o), ("kind_o", kind), ("graph", graph), ("inferred", inferred)):
        if value is not None:
            t = t.where(F.col(name) == value)
    return t if limit is None else t.orderBy("s", "p", "o").limit(limit)


_TERM = re.compile(r"\?(\w+)|<([^>]*)>|\"((?:[^\"\\]|\\.)*)\"(?:@[\w-]+|\^\^\S+)?|(\ba\b)|([\w-]*:[\w./#-]*)|([.;{}*])")


def parse_sparql(query: str) -> tuple[str, list[str], list[tuple]]:
    """(form, variables, patterns); a pattern has three ("var" | "iri" | "literal", value)."""
    prefixes = dict(S.NAMESPACES)
    for name, iri in re.findall(r"(?i)\bprefix\s+([\w-]*):\s*<([^>]*)>", query):
        prefixes[name] = iri
    m = re.search(r"(?is)\b(select|ask)\b(.*?)\{(.*)\}", query)
    if not m:
        raise ValueError("only SELECT and ASK with one group are understood")
    if re.search(r"(?i)\b(filter|optional|union|order\s+by|limit|distinct|group\s+by)\b", re.sub(r'"[^"]*"', "", query)):
        raise ValueError("only basic graph patterns are understood")
    terms, patterns = [], []
    for var, iri, literal, is_a, name, sign in _TERM.findall(m.group(3) + " ."):
        if sign in (".", ";"):
            if len(terms) == 3:
                patterns.append(tuple(terms))
                terms = terms[:1] if sign == ";" else []
            elif terms and len(terms) != 1:
                raise ValueError("a pattern has three terms")
            else:
                terms = []
        elif var:
            terms.append(("var", var))
        elif is_a:
            terms.append(("iri", TYPE))
        elif name:
            head, _, tail = name.partition(":")
            terms.append(("iri", prefixes[head] + tail if head in prefixes else name))
        elif iri:
            terms.append(("iri", iri))
        elif not sign:
            terms.append(("literal", literal.replace('\\"', '"')))
    return m.group(1).lower(), re.findall(r"\?(\w+)", m.group(2).split("WHERE")[0]), patterns


def solve(t: DataFrame, patterns: list[tuple]) -> DataFrame:
    """Bindings of a basic graph pattern: a join on shared variables for each pattern."""
    out = None
    for pattern in patterns:
        part, columns, seen = t, [], {}
        for slot, (kind, value) in zip(("s", "p", "o"), pattern, strict=True):
            if kind == "var":
                if value in seen:
                    part = part.where(F.col(slot) == F.col(seen[value]))
                else:
                    seen[value] = slot
                    columns.append(F.col(slot).alias(value))
            else:
                part = part.where(F.col(slot) == value)
                if slot == "o":
                    part = part.where(F.col("kind_o") == kind)
        part = part.select(*columns) if columns else part.select(F.lit(1).alias("_one")).limit(1)
        if out is None:
            out = part
        else:
            shared = [c for c in part.columns if c in out.columns]
            out = out.join(part, shared) if shared else out.crossJoin(part)
    return out


def sparql(t: DataFrame, query: str) -> DataFrame:
    form, variables, patterns = parse_sparql(query)
    found = solve(t, patterns)
    if form == "ask":
        return found.limit(1).agg((F.count("*") > 0).alias("ask"))
    return found.select(*[v for v in variables if v in found.columns]) if variables else found.drop("_one")


#: Rules (of, to) that go to every task at most; more are joined by their key.  Triples for a task.
FEW, SHARE = 100_000, 200_000


def _rules(rows: DataFrame, p: str) -> DataFrame:
    return rows.where(F.col("p") == p).select(F.col("s").alias("of"), F.col("o").alias("to"))


def _everywhere(rules: DataFrame, many: bool) -> DataFrame:
    return rules if many else F.broadcast(rules)


def _closed(rules: DataFrame) -> tuple[DataFrame, bool]:
    """Rules with those that two of them make, and whether they are many."""
    rules = cut(rules.distinct())
    a, b = rules.alias("a"), _everywhere(rules, rules.count() > FEW).alias("b")
    two = a.join(b, F.col("a.to") == F.col("b.of")).where(F.col("a.of") != F.col("b.to")).select("a.of", "b.to")
    out = cut(rules.unionByName(two).distinct())
    return out, out.count() > FEW


def _follow(rows: DataFrame, key: Column, rules: tuple[DataFrame, bool], made: Callable[[Column], tuple]) -> DataFrame:
    """The rows, each followed by what the rules of its key make of it; no row leaves its task where rules are few,
    so a predicate that most triples have is dealt like any other."""
    by = rules[0].groupBy("of").agg(F.collect_list(F.struct("to")).alias("_to"))
    joined = rows.withColumn("_key", key).join(_everywhere(by, rules[1]), F.col("_key") == F.col("of"), "left")
    row = lambda s, p, o, fresh: F.struct(s.alias("s"), p.alias("p"), o.alias("o"), fresh.alias("fresh"))
    own = F.array(row(F.col("s"), F.col("p"), F.col("o"), F.col("fresh")))
    new = F.transform(F.col("_to"), lambda x: row(*made(x["to"]), F.lit(True)))
    # explode() would have its array made twice, the first time to see whether it is empty
    return joined.select(F.explode_outer(F.when(F.col("_to").isNull(), own).otherwise(F.concat(own, new))).alias("r")).select("r.*")


def _rdfs_pass(known: DataFrame) -> DataFrame:
    """(s, p, o, fresh) of all triples known and made, each once; fresh is whether it was made alone."""
    classes, properties = _closed(_rules(known, SUB_CLASS)), _closed(_rules(known, SUB_PROPERTY))

    def first_four(rows: DataFrame) -> DataFrame:
        for p, (rules, _) in ((SUB_CLASS, classes), (SUB_PROPERTY, properties)):
            rows = rows.unionByName(rules.select(F.col("of").alias("s"), F.lit(p).alias("p"), F.col("to").alias("o"), F.lit(True).alias("fresh")))
        rows = _follow(rows, F.when(F.col("p") == TYPE, F.col("o")), classes, lambda x: (F.col("s"), F.lit(TYPE), x))
        return _follow(rows, F.col("p"), properties, lambda x: (F.col("s"), x, F.col("o")))

    ends = cut(first_four(known).where(F.col("p").isin(DOMAIN, RANGE)).select("s", "p", "o").distinct())
    many = ends.count() > FEW
    # the text of triples packs so well that parts of equal bytes would be too large when unpacked, so rows count
    parts = known.count() // SHARE + 1
    rows = first_four(known.repartition(parts, "s", "p", "o"))
    for rule, end in ((DOMAIN, "s"), (RANGE, "o")):
        rows = _follow(rows, F.col("p"), (_rules(ends, rule), many), lambda x, end=end: (F.col(end), F.lit(TYPE), x))
    return rows.repartition(4 * parts, "s", "p", "o").groupBy("s", "p", "o").agg(F.min("fresh").alias("fresh"))


def rdfs_infer(t: DataFrame, max_iter: int = 1) -> DataFrame:
    """The new triples of six rules in order, each seeing what those before it found.

    One pass by default; more until nothing is new.
    """
    known, n = t.select("s", "p", "o", F.lit(False).alias("fresh")), None
    for i in range(max_iter):
        known = _rdfs_pass(known)
        if i + 1 < max_iter:
            known = cut(known)
            before, n = n, known.count()
            if n == before or known.where("fresh").isEmpty():
                break
    return known.where("fresh").select("s", "p", "o")


def as_inferred(found: DataFrame) -> DataFrame:
    null = F.lit(None).cast("string")
    return found.select("s", "p", "o", F.lit("iri").alias("kind_o"), null.alias("datatype"), null.alias("language"), null.alias("graph"), F.lit(True).alias("inferred"))


def clear_inferred(t: DataFrame) -> DataFrame:
    return t.where(~F.col("inferred"))


def shacl_validate(t: DataFrame) -> DataFrame:
    """(node, shape, prop, path, rule, value) of every breach of datatype, pattern (a substring) or minCount.

    `prop` is the property node whose rule is broken; `shape`, as in the reference, is the same node for datatype
    and pattern, and the whole shape for minCount.
    """
    get = lambda p, name: t.where(F.col("p") == SH + p).select(F.col("s").alias("of"), F.col("o").alias(name))
    target = get("targetClass", "cls").withColumnRenamed("of", "shape")
    prop = get("property", "prop").withColumnRenamed("of", "shape")
    path = get("path", "path").withColumnRenamed("of", "prop")
    rules = target.join(prop, "shape").join(path, "prop")
    inst = t.where(F.col("p") == TYPE).select(F.col("s").alias("node"), F.col("o").alias("cls")).distinct()
    nodes = inst.join(rules, "cls")
    values = t.select(F.col("s").alias("node"), F.col("p").alias("path"), F.col("o").alias("value"), "kind_o", "datatype")
    have = nodes.join(values, ["node", "path"])
    kind = have.join(get("datatype", "want").withColumnRenamed("of", "prop"), "prop").where((F.col("kind_o") != "literal") | ~F.col("datatype").eqNullSafe(F.col("want")))
    kind = kind.select("node", F.col("prop").alias("shape"), "prop", "path", F.lit("datatype").alias("rule"), "value")
    text = have.where("kind_o = 'literal'").join(get("pattern", "want").withColumnRenamed("of", "prop"), "prop").where(~F.col("value").contains(F.col("want")))
    text = text.select("node", F.col("prop").alias("shape"), "prop", "path", F.lit("pattern").alias("rule"), "value")
    n = nodes.join(get("minCount", "want").withColumnRenamed("of", "prop"), "prop").join(values.select("node", "path", "value"), ["node", "path"], "left")
    n = n.groupBy("node", "shape", "prop", "path", "want").agg(F.count("value").alias("n")).where(F.col("n") < F.col("want").try_cast("int"))
    n = n.select("node", "shape", "prop", "path", F.lit("minCount").alias("rule"), F.col("n").cast("string").alias("value"))
    return kind.unionByName(text).unionByName(n)


_LINE = r'^<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s+\.$'


def import_ntriples(spark: SparkSession, text: str) -> tuple[DataFrame, int]:
    """The triples of a text up to its first malformed line, and their number."""
    lines = spark.createDataFrame(list(enumerate(text.split("\n"))), "position long, value string")
    found = cut(parse_ntriples(lines, position="position"))
    return found, found.count()


def parse_ntriples(lines: DataFrame, column: str = "value", position: str | None = None) -> DataFrame:
    """Triples of all well-formed lines; comments and blank lines give none.  With a column of positions the
    lines from the first malformed one on give none either; without one malformed lines alone are left out."""
    line = F.trim(F.col(column))
    if position is not None:
        bad = lines.where((line != "") & ~line.startswith("#") & ~line.rlike(_LINE)).agg(F.min(position).alias("_bad"))
        lines = lines.crossJoin(F.broadcast(bad)).where(F.col("_bad").isNull() | (F.col(position) < F.col("_bad"))).drop("_bad")
    part = lambda i: F.regexp_extract(line, _LINE, i)
    some = lambda c: F.when(c != "", c)
    is_iri = line.rlike(r"^<[^>]*>\s+<[^>]*>\s+<")
    unescaped = F.regexp_replace(F.regexp_replace(part(4), r'\\"', '"'), r"\\n", "\n")
    return lines.where(line.rlike(_LINE)).select(
        part(1).alias("s"), part(2).alias("p"), F.when(is_iri, part(3)).otherwise(unescaped).alias("o"), F.when(is_iri, "iri").otherwise("literal").alias("kind_o"),
        some(part(6)).alias("datatype"), some(part(5)).alias("language"), F.lit(None).cast("string").alias("graph"), F.lit(False).alias("inferred"),
    )


def format_ntriples(t: DataFrame) -> DataFrame:
    """(value) lines in order."""
    o = F.replace(F.replace(F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    tail = F.when(F.col("language").isNotNull(), F.concat(F.lit("@"), "language")).when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), "datatype", F.lit(">"))).otherwise("")
    term = F.when(F.col("kind_o") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), o, F.lit('"'), tail))
    return t.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), term, F.lit(" .")).alias("value")).orderBy("value")


class Ontology:
    """Collects triples by their meaning and asks over them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    def define_class(self, name: str, parent: str | None = None) -> Ontology:
        self.rows.append(triple(name, TYPE, RDFS + "Class"))
        return self.relation(name, SUB_CLASS, parent) if parent else self

    def define_property(self, name: str, domain: str | None = None, range_: str | None = None, parent: str | None = None) -> Ontology:
        self.rows.append(triple(name, TYPE, RDF + "Property"))
        for p, o in ((DOMAIN, domain), (RANGE, range_), (SUB_PROPERTY, parent)):
            if o:
                self.relation(name, p, o)
        return self

    def define_shape(self, shape: str, target: str, properties: list[dict]) -> Ontology:
        self.rows.append(triple(shape, SH + "targetClass", target))
        for i, rule in enumerate(properties):
            node = f"{shape}/property/{i}"
            self.relation(shape, SH + "property", node).relation(node, SH + "path", rule["path"])
            if "datatype" in rule:
                self.relation(node, SH + "datatype", rule["datatype"])
            for k in ("pattern", "minCount"):
                if k in rule:
                    self.fact(node, SH + k, str(rule[k]))
        return self

    def define_sub_property(self, name: str, parent: str) -> Ontology:
        return self.relation(name, SUB_PROPERTY, parent)

    def typed_fact(self, s: str, p: str, value: str, datatype: str) -> Ontology:
        return self.fact(s, p, value, datatype)

    def query(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        return match(self.triples(), s, p, o)

    def add_type(self, s: str, cls: str) -> Ontology:
        return self.relation(s, TYPE, cls)

    def relation(self, s: str, p: str, o: str) -> Ontology:
        self.rows.append(triple(s, p, o))
        return self

    def fact(self, s: str, p: str, value: str, datatype: str | None = None, language: str | None = None) -> Ontology:
        self.rows.append(triple(s, p, value, "literal", datatype, language))
        return self

    def triples(self) -> DataFrame:
        return make(self.spark, self.rows).dropDuplicates(["s", "p", "o"])

    def infer(self, max_iter: int = 1) -> DataFrame:
        return rdfs_infer(self.triples(), max_iter)

    def validate(self) -> DataFrame:
        return shacl_validate(self.triples())

    def sparql(self, query: str) -> DataFrame:
        return sparql(self.triples(), query)


