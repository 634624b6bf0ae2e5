import pytest

from quern.plans import clause, rewrite, selection, text
from quern.plans.clause import Settings
from quern.sources import ddl


def test_clause():
    sql, c = clause.strip("SELECT avg(x) a FROM t WITH ERROR 0.1 CONFIDENCE 0.9 BEHAVIOR 'Strict'")
    assert sql.strip() == "SELECT avg(x) a FROM t" and (c.error, c.confidence, c.behavior) == (0.1, 0.9, "STRICT")
    assert clause.strip("SELECT 'with error 0.1' FROM t")[1] is None
    assert clause.strip("SELECT * FROM (SELECT sum(x) FROM t WITH ERROR 0.3) q")[0].count("ERROR") == 0
    for bad in ("WITH ERROR 0", "WITH ERROR 1", "WITH ERROR 1.3", "WITH ERROR 0.1 CONFIDENCE 1", "WITH ERROR 0.1 CONFIDENCE 0", "WITH ERROR 0.1 BEHAVIOR 'odd'"):
        with pytest.raises(ValueError):
            clause.strip(f"SELECT sum(x) FROM t {bad}")


def test_precedence():
    of = lambda tail, **conf: clause.resolve(clause.strip("SELECT 1 FROM t " + tail)[1], conf)
    assert of("WITH ERROR 0.1") == Settings(0.1, 0.95, "RUN_ON_FULL_TABLE")
    assert of("WITH ERROR") == Settings(0.2, 0.95, "DO_NOTHING")
    assert of("", error=0.3) == Settings(0.3, 0.95, "DO_NOTHING")
    assert of("WITH ERROR 0.1 CONFIDENCE 0.8", error=0.3, confidence=0.7, behavior="strict") == Settings(0.1, 0.8, "STRICT")
    assert of("CONFIDENCE 0.8") is None and of("") is None and of("WITH ERROR -1.3") is None


def test_analysis():
    choose = selection.choose_analysis
    assert choose({"sum"}, error_functions=True) == "closed_form"
    assert choose({"avg"}, filtered=True, error_functions=True) == "bootstrap"
    assert choose({"avg"}, error_functions=True) == "closed_form"
    assert choose({"avg"}, having_on_group=True, error_functions=True) == "bootstrap"
    assert choose({"sum"}, closed_form=False, error_functions=True) == "bootstrap"
    assert choose({"min", "max"}, behavior="STRICT") == "bypass"
    assert choose({"sum"}) == "bypass"
    assert choose({"sum"}, behavior="STRICT") == "closed_form"
    assert choose(set()) == choose({"sum"}, unsupported=True) == "exact"
    assert choose({"count"}, joins=True, error_functions=True) == "bootstrap"
    assert choose({"sum"}, joins=True, error_functions=True) == "closed_form"
    assert choose({"sum"}, joins=True, other_distributed=True, error_functions=True) == "bootstrap"


def test_selection_needs_extremes_and_prefers_bypass():
    c = [selection.Candidate("a", frozenset({"x"}), 0.1), selection.Candidate("b", frozenset({"x", "y"}), 0.01), selection.Candidate("c", frozenset({"x", "z"}), 0.2, True)]
    assert selection.select_sample(c, {"x"}, set(), {"y"}).name == "b"
    assert selection.select_sample(c, {"q"}, set(), {"w"}) is None
    assert selection.select_sample(c[1:], {"x"}, set()).name == "c"


def test_blocks_and_tables():
    b = text.block("SELECT DISTINCT a, f(b, ')') AS c FROM t JOIN (SELECT 1 x FROM u) v ON t.a = v.x WHERE a IN (SELECT a FROM w) GROUP BY a HAVING count(*) > 1 ORDER BY 1 LIMIT 3")
    assert b.distinct and b.items == ["a", "f(b, ')') AS c"] and b.limit == "3"
    refs = text.tables(b.source)
    assert [(r.name, r.alias, r.join) for r in refs] == [("t", None, ""), (None, "v", "inner")]
    refs = text.tables("a x LEFT OUTER JOIN b AS y ON 1 = 1, c FULL JOIN d USING (k)")
    assert [(r.name, r.alias, r.join) for r in refs] == [("a", "x", ""), ("b", "y", "left outer"), ("c", None, "inner"), ("d", None, "full")]
    with pytest.raises(text.NotUnderstoodError):
        text.block("SELECT a FROM t UNION SELECT b FROM u")
    assert text.aliased("sum(x) total") == ("sum(x)", "total")
    assert text.aliased("CASE WHEN a THEN b END") == ("CASE WHEN a THEN b END", None)
    assert text.aliased("a + b") == ("a + b", None)
    assert text.ctes("WITH a AS (SELECT 1), b AS (SELECT 2) SELECT 3")[0] == {"a": "SELECT 1", "b": "SELECT 2"}


def test_error_functions_resolve_by_alias():
    with pytest.raises(rewrite.UnresolvedError):
        rewrite.plan(text.block("SELECT sum(x) AS s, absolute_error(q) FROM t"))
    p = rewrite.plan(text.block("SELECT k AS g, sum(x) AS s, absolute_error(s), sum( X ) + 1 FROM t GROUP BY g ORDER BY relative_error(s)"))
    assert len(p.aggs) == 1 and p.uses_errors and [n for _, n in p.items] == ["g", "s", "Absolute_Error(s)", "sum( X ) + 1"]
    assert rewrite.where_columns("t.a > 3 AND round(tan(b)) = 'x' OR NOT c IS NULL") == {"a", "round(tan(b))", "c"}


def test_ddl():
    s = ddl.parse("create sample table if not exists s on b options (qcs 'a,hour(ts)', fraction '0.03') as (select * from b)")
    assert (s.verb, s.kind, s.name, s.base, s.lenient, s.options) == ("CREATE", "SAMPLE", "s", "b", True, {"qcs": "a,hour(ts)", "fraction": "0.03"})
    s = ddl.parse("CREATE TABLE s (a INT, b DECIMAL(6,2)) USING column_sample OPTIONS (qcs 'a', baseTable 'b')")
    assert s.schema == "a INT, b DECIMAL(6,2)" and s.options["baseTable"] == "b"
    assert ddl.parse("CREATE TOPK TABLE t ON s OPTIONS (key 'k')").kind == "TOPK"
    assert ddl.parse("DROP TABLE IF EXISTS t").lenient and ddl.parse("TRUNCATE TABLE t").verb == "TRUNCATE"
    assert ddl.parse("SELECT 1") is None and ddl.parse("CREATE TABLE t (a INT) USING parquet") is None
