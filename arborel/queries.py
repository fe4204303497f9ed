"""The XPath queries of the driver contract, over the test tables, with SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import families
from .api import VERSIONS, Functions, Selector
from .operators import axes
from .plans import trees
from .plans.parser import StaticContext
from .plans.tables import query
from .sources import files, shred
from .sources.schema import Schema

KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"],
}
TABLES = tuple(KEYS)

#: A whole row of lineitem: a dateTime comes out as its string value.
_LINE = "* REPLACE (strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS l_shipdate)"
#: name -> (expression, SQL with the same columns)
EXPRESSIONS: dict[str, tuple[str, str]] = {
    "xp_path_predicate": ("/lineitem/row[l_quantity gt 45]/l_extendedprice", "SELECT l_extendedprice AS value FROM lineitem WHERE l_quantity > 45"),
    "xp_path_equal": ("/orders/row[o_orderstatus='F']/o_totalprice", "SELECT o_totalprice AS value FROM orders WHERE o_orderstatus = 'F'"),
    "xp_rows": ("/nation/row[n_regionkey = 1]", "SELECT * FROM nation WHERE n_regionkey = 1"),
    "xp_and_or": ("/part/row[p_size lt 10 and (p_retailprice gt 1000 or p_brand = 'Brand#12')]/p_partkey", "SELECT p_partkey AS value FROM part WHERE p_size < 10 AND (p_retailprice > 1000 OR p_brand = 'Brand#12')"),
    "xp_semi_join": ("/nation/row[n_regionkey = /region/row[r_name='ASIA']/r_regionkey]/n_name", "SELECT n_name AS value FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')"),
    "xp_anti_join": ("/customer/row[not(c_custkey = /orders/row[o_totalprice gt 100000]/o_custkey)]/c_custkey", "SELECT c_custkey AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)"),
    "xp_scalar_compare": ("/orders/row[o_totalprice > /orders/row[o_orderstatus='F']/o_totalprice]/o_orderkey", "SELECT o_orderkey AS value FROM orders WHERE o_totalprice > (SELECT min(o_totalprice) FROM orders WHERE o_orderstatus = 'F')"),
    "xp_scalar_aggregate": ("/orders/row[o_totalprice > max(/orders/row/o_totalprice) * 0.9e0]/o_orderkey", "SELECT o_orderkey AS value FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) FROM orders) * 0.9"),
    "xp_for_join": (
        "for $o in /orders/row, $c in /customer/row[c_custkey = $o/o_custkey] return map{'k': $o/o_orderkey, 'name': $c/c_name}",
        "SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey",
    ),
    "xp_for_three": (
        "for $n in /nation/row, $r in /region/row[r_regionkey = $n/n_regionkey], $s in /supplier/row[s_nationkey = $n/n_nationkey] return map{'s': $s/s_suppkey, 'r': $r/r_name}",
        "SELECT s_suppkey AS s, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey",
    ),
    "xp_for_where": (
        "for $o in /orders/row return if ($o/o_totalprice gt 200000) then map{'k': $o/o_orderkey, 'half': $o/o_totalprice div 2} else ()",
        "SELECT o_orderkey AS k, o_totalprice / 2 AS half FROM orders WHERE o_totalprice > 200000",
    ),
    "xp_group_sum": (
        "for $o in /orders/row return map{'k': $o/o_orderkey, 'q': sum(/lineitem/row[l_orderkey = $o/o_orderkey]/l_quantity)}",
        "SELECT o_orderkey AS k, coalesce(q, 0) AS q FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) AS g ON l_orderkey = o_orderkey",
    ),
    "xp_group_several": (
        "for $c in /customer/row return map{'k': $c/c_custkey, 'n': count(/orders/row[o_custkey = $c/c_custkey]), 'top': max(/orders/row[o_custkey = $c/c_custkey]/o_totalprice)}",
        "SELECT c_custkey AS k, coalesce(n, 0) AS n, top FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) AS g ON o_custkey = c_custkey",
    ),
    "xp_exists": (
        "for $c in /customer/row return if (exists(/orders/row[o_custkey = $c/c_custkey])) then $c/c_custkey else ()",
        "SELECT c_custkey AS value FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    ),
    "xp_some": (
        "for $o in /orders/row return if (some $l in /lineitem/row[l_orderkey = $o/o_orderkey] satisfies $l/l_quantity gt 49) then $o/o_orderkey else ()",
        "SELECT o_orderkey AS value FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)",
    ),
    "xp_every": (
        "for $o in /orders/row return if (every $l in /lineitem/row[l_orderkey = $o/o_orderkey] satisfies $l/l_quantity lt 40) then $o/o_orderkey else ()",
        "SELECT o_orderkey AS value FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT (l_quantity < 40))",
    ),
    "xp_count": ("count(/lineitem/row[l_returnflag = 'R'])", "SELECT count(*) AS value FROM lineitem WHERE l_returnflag = 'R'"),
    "xp_sum": ("sum(/part/row/p_size)", "SELECT sum(p_size)::BIGINT AS value FROM part"),
    "xp_avg": ("avg(/lineitem/row/l_quantity)", "SELECT avg(l_quantity) AS value FROM lineitem"),
    "xp_min": ("min(/orders/row/o_totalprice)", "SELECT min(o_totalprice) AS value FROM orders"),
    "xp_max": ("max(/part/row/p_retailprice)", "SELECT max(p_retailprice) AS value FROM part"),
    "xp_distinct_values": ("distinct-values(/part/row/p_brand)", "SELECT DISTINCT p_brand AS value FROM part"),
    "xp_string_join": ("string-join(/region/row/r_name, '|')", "SELECT string_agg(r_name, '|' ORDER BY r_regionkey) AS value FROM region"),
    "xp_union": ("/nation/row[n_regionkey = 1]/n_name | /nation/row[n_nationkey lt 5]/n_name", "SELECT n_name AS value FROM nation WHERE n_regionkey = 1 OR n_nationkey < 5"),
    "xp_intersect": ("/nation/row[n_regionkey = 1]/n_name intersect /nation/row[n_nationkey lt 12]/n_name", "SELECT n_name AS value FROM nation WHERE n_regionkey = 1 AND n_nationkey < 12"),
    "xp_except": ("/nation/row[n_regionkey = 1]/n_name except /nation/row[n_nationkey lt 12]/n_name", "SELECT n_name AS value FROM nation WHERE n_regionkey = 1 AND NOT n_nationkey < 12"),
    # rows of lineitem are no set by any of their columns: each is a node of its own
    "xp_union_rows": ("/lineitem/row[l_quantity gt 25] | /lineitem/row[l_returnflag = 'R']", f"SELECT {_LINE} FROM lineitem WHERE l_quantity > 25 OR l_returnflag = 'R'"),
    "xp_union_same": ("/lineitem/row[l_quantity gt 0]/l_orderkey | /lineitem/row[l_quantity gt 0]/l_orderkey", "SELECT l_orderkey AS value FROM lineitem"),
    "xp_intersect_rows": (
        "/lineitem/row[l_orderkey = /orders/row[o_orderstatus='F']/o_orderkey]/l_extendedprice intersect /lineitem/row[l_quantity lt 30]/l_extendedprice",
        "SELECT l_extendedprice AS value FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_quantity < 30",
    ),
    "xp_except_rows": ("/lineitem/row except /lineitem/row[l_quantity gt 25]", f"SELECT {_LINE} FROM lineitem WHERE NOT l_quantity > 25"),
    "xp_some_bound": ("/orders/row[some $l in /lineitem/row satisfies $l/l_extendedprice gt o_totalprice]/o_orderkey", "SELECT o_orderkey AS value FROM orders WHERE o_totalprice < (SELECT max(l_extendedprice) FROM lineitem)"),
    "xp_every_bound": ("/orders/row[every $l in /lineitem/row satisfies $l/l_extendedprice lt o_totalprice]/o_orderkey", "SELECT o_orderkey AS value FROM orders WHERE o_totalprice > (SELECT max(l_extendedprice) FROM lineitem)"),
    "xp_concatenation": ("(/region/row/r_name, /nation/row/n_name)", "SELECT r_name AS value FROM region UNION ALL SELECT n_name FROM nation"),
    "xp_position": ("/orders/row[position() le 10]/o_orderkey", "SELECT o_orderkey AS value FROM orders ORDER BY o_orderkey LIMIT 10"),
    "xp_last": ("/orders/row[last()]/o_orderkey", "SELECT max(o_orderkey) AS value FROM orders"),
    "xp_nth": ("/customer/row[7]/c_name", "SELECT c_name AS value FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 6"),
    "xp_top_k": (
        "subsequence(sort(/orders/row, (), function($r) { (-$r/o_totalprice, $r/o_orderkey) })/o_orderkey, 1, 10)",
        "SELECT o_orderkey AS value FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    ),
    "xp_simple_map": ("/region/row ! map{'k': r_regionkey, 'u': upper-case(r_name), 'n': string-length(r_name)}", "SELECT r_regionkey::BIGINT AS k, upper(r_name) AS u, length(r_name) AS n FROM region"),
    "xp_arithmetic": (
        "/part/row ! map{'k': p_partkey, 'a': p_size * 2 + 1, 'd': p_size idiv 7, 'm': p_size mod 7, 'neg': -p_size}",
        "SELECT p_partkey AS k, p_size::BIGINT * 2 + 1 AS a, (p_size // 7)::BIGINT AS d, (p_size % 7)::BIGINT AS m, -p_size::BIGINT AS neg FROM part",
    ),
    "xp_rounding": (
        "/supplier/row ! map{'k': s_suppkey, 'r': round(s_acctbal), 'f': floor(s_acctbal), 'c': ceiling(s_acctbal), 'a': abs(s_acctbal)}",
        "SELECT s_suppkey AS k, floor(s_acctbal + 0.5) AS r, floor(s_acctbal) AS f, ceil(s_acctbal) AS c, abs(s_acctbal) AS a FROM supplier",
    ),
    "xp_math": (
        "/part/row ! map{'k': p_partkey, 's': round(math:sqrt(p_retailprice) * 1000), 'l': round(math:log10(p_retailprice) * 1000), 'p': math:pow(p_size, 2)}",
        "SELECT p_partkey AS k, floor(sqrt(p_retailprice) * 1000 + 0.5) AS s, floor(log10(p_retailprice) * 1000 + 0.5) AS l, pow(p_size::DOUBLE, 2) AS p FROM part",
    ),
    "xp_strings": (
        "/documents/row ! map{'k': doc_id, 'n': string-length(text), 'u': lower-case(text), 'b': substring-before(text, ' '), 'a': substring-after(text, ' '), 't': translate(text, 'aeiou', 'AEI')}",
        "SELECT doc_id AS k, length(text) AS n, lower(text) AS u, CASE WHEN strpos(text, ' ') > 0 THEN substr(text, 1, strpos(text, ' ') - 1) ELSE '' END AS b, CASE WHEN strpos(text, ' ') > 0 THEN substr(text, strpos(text, ' ') + 1) ELSE '' END AS a,"
        " replace(replace(translate(text, 'aei', 'AEI'), 'o', ''), 'u', '') AS t FROM documents",
    ),
    "xp_substring": ("/documents/row ! map{'k': doc_id, 's': substring(text, 1, 12), 'm': substring(text, 31, 20), 'r': substring(text, 40)}", "SELECT doc_id AS k, substr(text, 1, 12) AS s, substr(text, 31, 20) AS m, substr(text, 40) AS r FROM documents"),
    "xp_string_tests": (
        "/documents/row[contains(text, 'the') and (starts-with(lang, 'e') or ends-with(source, '3'))]/doc_id",
        "SELECT doc_id AS value FROM documents WHERE contains(text, 'the') AND (starts_with(lang, 'e') OR source LIKE '%3')",
    ),
    "xp_concat": ("/nation/row ! (n_name || '/' || n_nationkey)", "SELECT n_name || '/' || n_nationkey AS value FROM nation"),
    "xp_normalize_space": ("/conversations/row ! map{'c': conv_id, 't': turn, 's': string-length(normalize-space(text))}", "SELECT conv_id AS c, turn AS t, length(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ')) AS s FROM conversations"),
    "xp_tokenize": ("/documents/row ! map{'k': doc_id, 'n': count(tokenize(text, '[ \\n]+'))}", "SELECT doc_id AS k, len(regexp_split_to_array(text, '[ \\n]+')) AS n FROM documents"),
    "xp_matches": ("/pages/row[matches(url, '^https://[a-z]+[.]example[.]com/')]/page_id", "SELECT page_id AS value FROM pages WHERE regexp_matches(url, '^https://[a-z]+[.]example[.]com/')"),
    "xp_replace": ("/pages/row ! map{'k': page_id, 'u': replace(url, '[?#].*$', '')}", "SELECT page_id AS k, regexp_replace(url, '[?#].*$', '', 'g') AS u FROM pages"),
    "xp_dates": (
        "/orders/row ! map{'k': o_orderkey, 'y': year-from-dateTime(o_orderdate), 'm': month-from-dateTime(o_orderdate), 'd': day-from-dateTime(o_orderdate)}",
        "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders",
    ),
    "xp_date_arithmetic": (
        "/orders/row[o_orderdate + xs:dayTimeDuration('P7D') gt xs:dateTime('1999-12-25T00:00:00')]/o_orderkey",
        "SELECT o_orderkey AS value FROM orders WHERE o_orderdate + INTERVAL 7 DAY > TIMESTAMP '1999-12-25 00:00:00'",
    ),
    "xp_date_string": ("/orders/row ! map{'k': o_orderkey, 's': string(xs:date(o_orderdate))}", "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS s FROM orders"),
    "xp_durations": (
        "/lineitem/row ! map{'k': l_orderkey, 'l': l_linenumber, 'd': days-from-duration(l_shipdate - xs:dateTime('1990-01-01T00:00:00'))}",
        "SELECT l_orderkey AS k, l_linenumber::BIGINT AS l, date_diff('day', TIMESTAMP '1990-01-01', date_trunc('day', l_shipdate)) AS d FROM lineitem",
    ),
    "xp_format_date": ("/orders/row ! map{'k': o_orderkey, 'f': format-dateTime(o_orderdate, '[Y0001]/[M01]/[D01]')}", "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y/%m/%d') AS f FROM orders"),
    "xp_json": ("/events/row ! map{'k': event_id, 'v': xs:integer(parse-json(props)?k)}", "SELECT event_id AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events"),
    "xp_casts": (
        "/events/row ! map{'k': event_id, 's': xs:string(user_id), 'i': xs:integer(value), 'c': event_type castable as xs:integer, 'b': xs:boolean(user_id)}",
        "SELECT event_id AS k, user_id::VARCHAR AS s, trunc(value)::BIGINT AS i, false AS c, user_id <> 0 AS b FROM events",
    ),
    "xp_conditional": (
        "/part/row ! map{'k': p_partkey, 'c': if (p_size lt 10) then 'small' else if (p_size lt 30) then 'middle' else 'large'}",
        "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS c FROM part",
    ),
    "xp_arrays": (
        "/embeddings/row ! map{'k': vec_id, 'n': array:size(embedding), 'h': xs:double(array:head(embedding)), 'last': xs:double(array:get(embedding, array:size(embedding)))}",
        "SELECT vec_id AS k, len(embedding) AS n, embedding[1]::DOUBLE AS h, embedding[len(embedding)]::DOUBLE AS last FROM embeddings",
    ),
    "xp_array_hof": (
        "/embeddings/row ! map{'k': vec_id, 'pos': array:size(array:filter(embedding, function($x) { $x gt 0 })), 'big': count(array:flatten(array:for-each(embedding, function($x) { $x * 2 }))[. gt 0.1])}",
        "SELECT vec_id AS k, len(list_filter(embedding, lambda x: x > 0)) AS pos, len(list_filter(embedding, lambda x: x * 2 > 0.1)) AS big FROM embeddings",
    ),
    "xp_fold": (
        "/documents/row ! map{'k': doc_id, 's': fold-left(1 to 5, 0, function($a, $b) { $a + $b * string-length(lang) })}",
        "SELECT doc_id AS k, 15 * length(lang) AS s FROM documents",
    ),
    "xp_let": (
        "for $p in /part/row return let $t := $p/p_retailprice * 2, $u := $t + 1 return map{'k': $p/p_partkey, 'u': $u}",
        "SELECT p_partkey AS k, p_retailprice * 2 + 1 AS u FROM part",
    ),
    "xp_range_for": ("for $n in /nation/row, $i in 1 to 3 return map{'k': $n/n_nationkey, 'i': $i}", "SELECT n_nationkey::BIGINT AS k, i FROM nation, (SELECT unnest([1, 2, 3])::BIGINT AS i) AS s"),
    "xp_general_sequence": ("/part/row[p_size = (1, 5, 9)]/p_partkey", "SELECT p_partkey AS value FROM part WHERE p_size IN (1, 5, 9)"),
    "xp_between": ("/lineitem/row[l_quantity = 10 to 12]/l_orderkey", "SELECT l_orderkey AS value FROM lineitem WHERE l_quantity IN (10, 11, 12)"),
    "xp_instance_of": ("/region/row ! map{'i': r_regionkey instance of xs:integer, 's': r_name instance of xs:string, 'n': r_name instance of xs:integer}", "SELECT true AS i, true AS s, false AS n FROM region"),
    "xp_arrow": ("/region/row ! (r_name => lower-case() => substring(1, 3))", "SELECT substr(lower(r_name), 1, 3) AS value FROM region"),
    "xp_compare": ("/customer/row ! map{'k': c_custkey, 'c': compare(c_mktsegment, 'BUILDING')}", "SELECT c_custkey AS k, CASE WHEN c_mktsegment < 'BUILDING' THEN -1 WHEN c_mktsegment > 'BUILDING' THEN 1 ELSE 0 END AS c FROM customer"),
    "xp_case_blind": (
        "/customer/row[contains(c_mktsegment, 'build', 'http://www.w3.org/2005/xpath-functions/collation/html-ascii-case-insensitive')]/c_custkey",
        "SELECT c_custkey AS value FROM customer WHERE lower(c_mktsegment) LIKE '%build%'",
    ),
    "xp_codepoints": ("/region/row ! map{'n': r_name, 'c': head(string-to-codepoints(r_name)), 's': sum(string-to-codepoints(r_name))}", "SELECT r_name AS n, ascii(r_name) AS c, list_sum(list_transform(string_split(r_name, ''), lambda x: ascii(x))) AS s FROM region"),
    "xp_encode": ("/pages/row ! map{'k': page_id, 'e': encode-for-uri(url)}", "SELECT page_id AS k, url_encode(url) AS e FROM pages"),
    "xp_format_integer": ("/part/row ! map{'k': p_partkey, 'f': format-integer(p_partkey, '000000')}", "SELECT p_partkey AS k, lpad(p_partkey::VARCHAR, 6, '0') AS f FROM part"),
    "xp_map_functions": (
        "/nation/row ! map{'k': n_nationkey, 's': map:size(map:put(map{'a': n_regionkey}, 'b', 2)), 'g': map:get(map{'a': n_regionkey, 'b': 7}, 'b'), 'c': map:contains(map{'a': 1}, 'x')}",
        "SELECT n_nationkey::BIGINT AS k, 2 AS s, 7 AS g, false AS c FROM nation",
    ),
    "xp_sequence_functions": (
        "/part/row ! map{'k': p_partkey, 'r': string-join(for $x in reverse((1, 2, p_size)) return string($x), ','), 'i': count(index-of((1, p_size, 5), 5)), 'd': count(distinct-values((1, p_size, 1)))}",
        "SELECT p_partkey AS k, p_size || ',2,1' AS r, 1 + (p_size = 5)::INT AS i, CASE WHEN p_size = 1 THEN 1 ELSE 2 END AS d FROM part",
    ),
}


def frames(spark: SparkSession, sf_dir: str, text: str = "") -> dict[str, DataFrame]:
    """The tables that an expression mentions."""
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if not text or f"/{t}/" in text or f"/{t}[" in text}


def table_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(frames(spark, sf_dir, text), text, StaticContext(), KEYS)


# the tree of orders and their items, numbered by the keys alone: order k has pre k * 1000, its items follow


def order_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, orders as elements under them, line items under these; all numbers come from the keys."""
    t = frames(spark, sf_dir)
    orders = t["orders"].select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") * 100 + 10).alias("pre"), F.col("o_orderpriority").alias("string_value"), F.col("o_orderkey").alias("key"))
    lines = t["lineitem"].groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    items = lines.join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") * 100 + 10 + F.col("l_linenumber")).alias("pre"), F.col("l_returnflag").alias("string_value"), F.col("l_orderkey").alias("key"))
    last = F.lit(1 << 50)
    roots = t["customer"].select(F.col("c_custkey").alias("doc_id"), F.lit(0).cast("long").alias("pre"), last.alias("last_desc"), F.lit(None).cast("long").alias("parent_pre"), F.lit("document").alias("kind"), F.lit("").alias("local"), F.lit("").alias("string_value"))
    nodes = orders.select("doc_id", "pre", (F.col("pre") + 89).alias("last_desc"), F.lit(0).cast("long").alias("parent_pre"), F.lit("element").alias("kind"), F.lit("order").alias("local"), "string_value")
    nodes = nodes.unionByName(items.select("doc_id", "pre", F.col("pre").alias("last_desc"), (F.col("key") * 100 + 10).alias("parent_pre"), F.lit("element").alias("kind"), F.lit("item").alias("local"), "string_value")).unionByName(roots)
    rest = {"level": F.lit(0), "ns_uri": F.lit(""), "prefix": F.lit(""), "value": F.lit(None).cast("string"), "sib_ord": F.col("pre").cast("int"), "path": F.concat(F.lit("/"), F.col("pre")), "ns_map": F.create_map().cast("map<string,string>"), "base_uri": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "id_value": F.lit(None).cast("string")}
    return nodes.select("*", *[c.alias(n) for n, c in rest.items()]).select(*axes.NODE)


_I = "SELECT o_custkey AS d, o_orderkey * 100 + 10 AS o_pre, o_orderkey * 100 + 10 + l_linenumber AS pre, l_returnflag AS flag, o_orderpriority AS prio FROM orders JOIN (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey"
#: name -> (expression, SQL with doc_id and pre)
AXES: dict[str, tuple[str, str]] = {
    "xp_axis_child": ("/order[. = '1-URGENT']/item", f"SELECT d AS doc_id, pre FROM ({_I}) WHERE prio = '1-URGENT'"),
    "xp_axis_descendant": ("//item[. = 'R']", f"SELECT d AS doc_id, pre FROM ({_I}) WHERE flag = 'R'"),
    "xp_axis_descendant_or_self": ("/order/descendant-or-self::*", f"SELECT d AS doc_id, pre FROM ({_I}) UNION SELECT o_custkey, o_orderkey * 100 + 10 FROM orders"),
    "xp_axis_self": ("/order/self::order[. = '5-LOW']", "SELECT o_custkey AS doc_id, o_orderkey * 100 + 10 AS pre FROM orders WHERE o_orderpriority = '5-LOW'"),
    "xp_axis_parent": ("//item[. = 'R']/..", f"SELECT DISTINCT d AS doc_id, o_pre AS pre FROM ({_I}) WHERE flag = 'R'"),
    "xp_axis_ancestor": ("//item[. = 'A']/ancestor::order", f"SELECT DISTINCT d AS doc_id, o_pre AS pre FROM ({_I}) WHERE flag = 'A'"),
    "xp_axis_ancestor_or_self": ("//item[. = 'A']/ancestor-or-self::*", f"SELECT d AS doc_id, pre FROM ({_I}) WHERE flag = 'A' UNION SELECT d, o_pre FROM ({_I}) WHERE flag = 'A'"),
    "xp_axis_following_sibling": ("//item[. = 'R']/following-sibling::item", f"SELECT DISTINCT a.d AS doc_id, a.pre AS pre FROM ({_I}) a JOIN ({_I}) b ON a.o_pre = b.o_pre WHERE b.flag = 'R' AND a.pre > b.pre"),
    "xp_axis_preceding_sibling": ("//item[. = 'R']/preceding-sibling::item", f"SELECT DISTINCT a.d AS doc_id, a.pre AS pre FROM ({_I}) a JOIN ({_I}) b ON a.o_pre = b.o_pre WHERE b.flag = 'R' AND a.pre < b.pre"),
    "xp_axis_following": ("/order[. = '1-URGENT']/following::item", "SELECT DISTINCT a.d AS doc_id, a.pre AS pre FROM (" + _I + ") a JOIN (SELECT o_custkey AS d, min(o_orderkey * 100 + 10) AS first FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) b ON a.d = b.d WHERE a.pre > b.first + 89"),
    "xp_axis_preceding": ("/order[. = '1-URGENT']/preceding::order", "SELECT o_custkey AS doc_id, o_orderkey * 100 + 10 AS pre FROM orders JOIN (SELECT o_custkey AS d, max(o_orderkey) AS last FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) b ON o_custkey = b.d WHERE o_orderkey < b.last"),
    "xp_step_position": ("/order/item[2]", f"SELECT doc_id, pre FROM (SELECT d AS doc_id, pre, row_number() OVER (PARTITION BY o_pre ORDER BY pre) AS r FROM ({_I})) WHERE r = 2"),
    "xp_step_last": ("/order/item[last()]", f"SELECT d AS doc_id, max(pre) AS pre FROM ({_I}) GROUP BY d, o_pre"),
    "xp_reverse_position": ("//item[last()]/preceding-sibling::item[1]", f"SELECT doc_id, pre FROM (SELECT d AS doc_id, pre, row_number() OVER (PARTITION BY o_pre ORDER BY pre DESC) AS r FROM ({_I})) WHERE r = 2"),
    "xp_nested_predicate": ("/order[item[. = 'R']][count(item) gt 4]", f"SELECT d AS doc_id, o_pre AS pre FROM ({_I}) GROUP BY d, o_pre HAVING count(*) > 4 AND bool_or(flag = 'R')"),
    "xp_node_except": ("/order except /order[item = 'R']", f"SELECT o_custkey AS doc_id, o_orderkey * 100 + 10 AS pre FROM orders WHERE o_orderkey * 100 + 10 NOT IN (SELECT o_pre FROM ({_I}) WHERE flag = 'R')"),
    "xp_innermost": ("innermost(//*)", f"SELECT d AS doc_id, pre FROM ({_I}) UNION SELECT o_custkey, o_orderkey * 100 + 10 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "xp_outermost": ("outermost(//*)", "SELECT o_custkey AS doc_id, o_orderkey * 100 + 10 AS pre FROM orders"),
}


def axis_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: trees.select(order_tree(spark, sf_dir), text).select("doc_id", "pre")


def tree_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.select(order_tree(spark, sf_dir), "count(//item)")


def customer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml, uri): an XML document for each customer."""
    parts = families.XML.replace("}", "{").split("{")
    xml = F.concat(*[F.col(x).cast("string") if k % 2 else F.lit(x) for k, x in enumerate(parts)])
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select(F.col("c_custkey").alias("doc_id"), xml.alias("xml"), F.concat(F.lit("http://x/"), "c_custkey").alias("uri"))


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of these documents."""
    return shred.xml_nodes(customer_texts(spark, sf_dir), uri="uri")


def parsed_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Selector(text, StaticContext(namespaces=families.NAMESPACES)).over_rows(customer_texts(spark, sf_dir)).select("doc_id", "value")


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function of the caller inside an expression, over all parts."""
    own = Functions()
    own.external("my:cube", lambda x: None if x is None else x**3, ("xs:integer",), "xs:integer")
    static = StaticContext(namespaces=(("my", "http://my"),))
    return Selector("my:cube(p_size) + 1", static).over_rows(spark.read.parquet(f"{sf_dir}/part.parquet"), own).select("p_partkey", "value")


def version_query(version: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Selector(text, VERSIONS[version]).over_rows(spark.read.parquet(f"{sf_dir}/part.parquet")).select("p_partkey", "value")


def environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environment variables that the static context gives, over all regions."""
    static = StaticContext(environment=(("A", "1"), ("B", "2")), base_uri="http://base/x")
    text = "concat(environment-variable('A'), '/', string-join(available-environment-variables(), ','), '/', r_name, '/', static-base-uri(), '/', empty(environment-variable('C')))"
    return Selector(text, static).over_rows(spark.read.parquet(f"{sf_dir}/region.parquet")).select("r_regionkey", "value")


def schema_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """An expression over the documents of customers under a schema."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = trees.select(customer_documents(spark, sf_dir), text, StaticContext(namespaces=families.NAMESPACES), Schema(families.XSD))
        return out.select("doc_id", "pre") if "pre" in out.columns else out

    return run


def schema_constructor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constructor that a schema defines, over all parts."""
    own = Functions()
    own.schema(Schema(families.XSD), "c")
    return Selector("c:code(p_size mod 50) + 1", StaticContext(namespaces=families.NAMESPACES)).over_rows(spark.read.parquet(f"{sf_dir}/part.parquet"), own).select("p_partkey", "value")


#: Queries of the programming interface: name -> (builder, SQL)
INTERFACE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "xp_parse_xml": (parsed_query("count(parse-xml(xml)//*) + sum(parse-xml(xml)//c:code)"), "SELECT c_custkey AS doc_id, 5 + c_nationkey::DOUBLE AS value FROM customer"),
    "xp_parse_xml_path": (parsed_query("string-join(parse-xml(xml)/c:customer/@*, '|')"), "SELECT c_custkey AS doc_id, 'en-US|c' || c_custkey || '|' || c_custkey || '|' || c_nationkey AS value FROM customer"),
    "xp_parse_xml_fragment": (parsed_query("string-join(parse-xml-fragment(concat('a', doc_id, '<b>c</b>d'))/node(), '.')"), "SELECT c_custkey AS doc_id, 'a' || c_custkey || '.c.d' AS value FROM customer"),
    "xp_external_function": (external, "SELECT p_partkey, p_size::BIGINT * p_size * p_size + 1 AS value FROM part"),
    "xp_version_1": (version_query("1.0", "concat(p_name, '-', p_size * 2) = concat(p_name, '-', '20') or p_brand = 12"), "SELECT p_partkey, p_size = 10 AS value FROM part"),
    "xp_version_2": (version_query("2.0", "for $x in (1 to 3) return $x * p_size"), "SELECT p_partkey, [p_size::BIGINT, p_size::BIGINT * 2, p_size::BIGINT * 3] AS value FROM part"),
    "xp_version_30": (version_query("3.0", "let $x := p_size return ($x ! (. + 1)) || '!'"), "SELECT p_partkey, (p_size + 1) || '!' AS value FROM part"),
    "xp_schema_typed": (schema_query("sum(//c:code) + 1"), "SELECT c_custkey AS doc_id, c_nationkey::BIGINT + 1 AS value FROM customer"),
    "xp_schema_instance": (schema_query("//c:code instance of xs:integer"), "SELECT c_custkey AS doc_id, true AS value FROM customer"),
    "xp_schema_element": (schema_query("//schema-element(c:code)"), "SELECT c_custkey AS doc_id, 10::BIGINT AS pre FROM customer"),
    "xp_schema_constructor": (schema_constructor, "SELECT p_partkey, p_size::BIGINT % 50 + 1 AS value FROM part"),
    "xp_environment": (environment, "SELECT r_regionkey, '1/A,B/' || r_name || '/http://base/x/true' AS value FROM region"),
}


def tree_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = trees.select(customer_documents(spark, sf_dir), text, StaticContext(namespaces=families.NAMESPACES))
        return out.select(*[c for c in ("doc_id", "of", "pre") if c in out.columns]) if "pre" in out.columns else out

    return run


def serialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of customers, written again from their nodes."""
    return files.serialize(customer_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: table_query(text) for name, (text, _) in (EXPRESSIONS | families.TABLE_FAMILIES).items()}
    out |= {name: tree_query(text) for name, (text, _) in families.TREE_FAMILIES.items()}
    out |= {name: axis_query(text) for name, (text, _) in AXES.items()}
    out |= {name: build for name, (build, _) in INTERFACE.items()}
    return out | {"xp_tree_count": tree_count, "xp_tree_serialize": serialized}


def oracle_sql() -> dict[str, str]:
    out = {name: sql for name, (_, sql) in (EXPRESSIONS | families.TABLE_FAMILIES | AXES | families.TREE_FAMILIES).items()}
    out |= {name: sql for name, (_, sql) in INTERFACE.items()}
    count = "SELECT c_custkey AS doc_id, coalesce(n, 0) AS value FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) AS i ON l_orderkey = o_orderkey GROUP BY o_custkey) AS g ON o_custkey = c_custkey"
    parts = families.XML.replace("}", "{").split("{")
    xml = " || ".join(x if k % 2 else f"'{x}'" for k, x in enumerate(parts))
    return out | {"xp_tree_count": count, "xp_tree_serialize": f"SELECT c_custkey AS doc_id, {xml} AS text FROM customer"}
