"""Scalar functions, family by family."""

from __future__ import annotations

from ._case import case

CASES: dict = {}


def _c(name, text, oracle=None):
    case(CASES, name, text, oracle)


_c("fn_text_case", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, length(p_name) AS n, reverse(p_brand) AS r, repeat(p_brand, 2) AS rp FROM part")
_c("fn_text_cut", "SELECT p_partkey, left(p_name, 3) AS a, left(p_name, -2) AS b, right(p_name, 3) AS c, right(p_name, -2) AS d, substring(p_name, 2, 4) AS e, substr(p_name, 3) AS f, split_part(p_type, ' ', 2) AS g FROM part")
_c("fn_text_pad_trim", "SELECT p_partkey, lpad(p_brand, 12, '*') AS a, rpad(p_brand, 12, '-') AS b, trim(BOTH 'B' FROM p_brand) AS c, ltrim('xxab', 'x') AS d, rtrim('abxx', 'x') AS e, btrim('xabx', 'x') AS f FROM part", "SELECT p_partkey, lpad(p_brand, 12, '*') AS a, rpad(p_brand, 12, '-') AS b, trim(p_brand, 'B') AS c, ltrim('xxab', 'x') AS d, rtrim('abxx', 'x') AS e, trim('xabx', 'x') AS f FROM part")
_c("fn_text_find", "SELECT p_partkey, strpos(p_name, 'e') AS a, position('a' IN p_name) AS b, starts_with(p_brand, 'Brand') AS c, replace(p_type, 'A', '@') AS d, translate(p_brand, 'Bd', 'XY') AS e FROM part")
_c("fn_text_concat", "SELECT n_nationkey, concat(n_name, NULL, '-', n_regionkey) AS a, concat_ws('/', n_name, NULL, 'z') AS b, n_name || '!' AS c, ascii(n_name) AS d, chr(300 + n_nationkey) AS e, md5(n_name) AS f, to_hex(n_nationkey) AS g FROM nation", "SELECT n_nationkey, concat(n_name, NULL, '-', n_regionkey) AS a, concat_ws('/', n_name, NULL, 'z') AS b, n_name || '!' AS c, ascii(n_name) AS d, chr(300 + n_nationkey) AS e, md5(n_name) AS f, lower(to_hex(n_nationkey)) AS g FROM nation")
_c("fn_text_initcap", "SELECT initcap('hELLO wORLD-foo bar2baz') AS a, initcap('x_y z') AS b", "SELECT 'Hello World-Foo Bar2baz' AS a, 'X_Y Z' AS b")
_c("fn_regex", "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '_') AS a, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS b, regexp_count(p_type, '[AEIOU]') AS c, regexp_like(p_brand, '#1') AS d, array_to_string(regexp_split_to_array(p_type, ' '), '|') AS e FROM part",
   "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '_') AS a, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS b, len(regexp_extract_all(p_type, '[AEIOU]')) AS c, regexp_matches(p_brand, '#1') AS d, replace(p_type, ' ', '|') AS e FROM part")
_c("fn_quote_format", "SELECT quote_literal('it''s') AS a, quote_ident('Ab') AS b, quote_nullable(NULL) AS c, format('%s-%I-%L', 'x', 'y z', 'q') AS d", """SELECT '''it''''s''' AS a, '"Ab"' AS b, 'NULL' AS c, 'x-"y z"-''q''' AS d""")
_c("fn_encode", "SELECT encode('abc', 'base64') AS a, encode('abc', 'hex') AS b, convert_from(decode('616263', 'hex'), 'UTF8') AS c, encode(sha256('abc'), 'hex') AS d", "SELECT 'YWJj' AS a, '616263' AS b, 'abc' AS c, sha256('abc') AS d")
_c("fn_normalize", "SELECT length(normalize('e' || chr(769))) AS a, normalize('x') IS NOT NULL AS b, unistr('\\0041') AS c", "SELECT 1 AS a, true AS b, 'A' AS c")
_c("fn_math", "SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, ceil(l_extendedprice) AS b, floor(l_extendedprice) AS c, round(l_extendedprice) AS d, round(sqrt(l_quantity), 8) AS e, round(ln(l_quantity), 8) AS f, round(exp(l_discount), 8) AS g, CAST(sign(l_tax - 0.04) AS int) AS h, mod(l_orderkey, 13) AS i, power(l_linenumber, 3) AS j FROM lineitem",
   "SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, ceil(l_extendedprice) AS b, floor(l_extendedprice) AS c, round(l_extendedprice) AS d, round(sqrt(l_quantity), 8) AS e, round(ln(l_quantity), 8) AS f, round(exp(l_discount), 8) AS g, CAST(sign(l_tax - 0.04) AS int) AS h, mod(l_orderkey, 13) AS i, power(l_linenumber, 3) AS j FROM lineitem")
_c("fn_math_trig", "SELECT round(sind(30), 6) AS a, round(cosd(60), 6) AS b, round(tand(45), 6) AS c, round(atan2d(1, 1), 6) AS d, round(cbrt(27), 6) AS e, round(degrees(pi()), 6) AS f, round(erf(0.5), 6) AS g, round(sinh(1), 6) AS h", "SELECT 0.5 AS a, 0.5 AS b, 1.0 AS c, 45.0 AS d, 3.0 AS e, 180.0 AS f, 0.5205 AS g, round(sinh(1), 6) AS h")
_c("fn_math_integers", "SELECT gcd(n_nationkey + 12, 18) AS a, lcm(4, 6) AS b, factorial(5) AS c, width_bucket(5.35, 0.024, 10.06, 5) AS d, trunc(-2.75) AS e, bit_count(7) AS f, num_nulls(1, NULL, 3) AS g, num_nonnulls(1, NULL) AS h, n_nationkey # 5 AS i, n_nationkey << 2 AS j, n_nationkey & 6 AS k FROM nation",
   "SELECT gcd(n_nationkey + 12, 18) AS a, 12 AS b, 120 AS c, 3 AS d, -2.0 AS e, 3 AS f, 1 AS g, 1 AS h, xor(n_nationkey, 5) AS i, n_nationkey << 2 AS j, n_nationkey & 6 AS k FROM nation")
_c("fn_greatest_least", "SELECT l_orderkey, l_linenumber, greatest(l_quantity, 25.0, NULL) AS a, least(l_quantity, 25.0) AS b FROM lineitem")
_c("fn_date_parts", "SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, extract(day FROM o_orderdate) AS d, extract(dow FROM o_orderdate) AS dw, extract(isodow FROM o_orderdate) AS idw, extract(doy FROM o_orderdate) AS dy, extract(quarter FROM o_orderdate) AS q, extract(week FROM o_orderdate) AS w, date_part('century', o_orderdate) AS c, extract(decade FROM o_orderdate) AS de, extract(epoch FROM o_orderdate) AS ep FROM orders")
_c("fn_date_trunc", "SELECT o_orderkey, date_trunc('year', o_orderdate) AS y, date_trunc('quarter', o_orderdate) AS q, date_trunc('decade', o_orderdate) AS d FROM orders", "SELECT o_orderkey, date_trunc('year', o_orderdate)::TIMESTAMP AS y, date_trunc('quarter', o_orderdate)::TIMESTAMP AS q, date_trunc('decade', o_orderdate)::TIMESTAMP AS d FROM orders")
_c("fn_date_arith", "SELECT o_orderkey, o_orderdate + INTERVAL '10 days' AS a, o_orderdate - INTERVAL '1 month' AS b, make_date(1999, 2, 3) AS c, to_date('05/06/2001', 'DD/MM/YYYY') AS d, to_char(o_orderdate, 'YYYY-MM-DD') AS e FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 10 DAY AS a, o_orderdate - INTERVAL 1 MONTH AS b, make_date(1999, 2, 3) AS c, DATE '2001-06-05' AS d, strftime(o_orderdate, '%Y-%m-%d') AS e FROM orders")
_c("fn_date_bin", "SELECT event_id, date_bin(INTERVAL '15 minutes', ts, TIMESTAMP '2000-01-01 00:00:00') AS b FROM events", "SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2000-01-01 00:00:00') AS b FROM events")
_c("fn_age", "SELECT age(TIMESTAMP '2001-04-10 00:00:00', TIMESTAMP '1957-06-13 00:00:00').months AS m, age(TIMESTAMP '2001-04-10 00:00:00', TIMESTAMP '1957-06-13 00:00:00').days AS d", "SELECT 525 AS m, 28 AS d")
_c("fn_arrays", "SELECT array_length(ARRAY[1,2,3], 1) AS a, (ARRAY[10,20,30])[2] AS b, (ARRAY[1,2])[5] IS NULL AS c, array_position(ARRAY[5,6,7], 7) AS d, array_position(ARRAY[5,6], 9) IS NULL AS e, array_to_string(array_append(ARRAY[1,2], 3), ',') AS f, array_to_string(array_remove(ARRAY[1,2,1], 1), ',') AS g, cardinality(array_cat(ARRAY[1], ARRAY[2,3])) AS h, array_to_string(array_replace(ARRAY[1,2,1], 1, 9), ',') AS i, ARRAY[1,2,3] @> ARRAY[2] AS j, ARRAY[1] <@ ARRAY[1,2] AS k, ARRAY[1,2] && ARRAY[2,5] AS l, array_upper(ARRAY[4,5], 1) AS m, array_to_string((ARRAY[1,2,3,4])[2:3], ',') AS n",
   "SELECT 3 AS a, 20 AS b, true AS c, 3 AS d, true AS e, '1,2,3' AS f, '2' AS g, 3 AS h, '9,2,9' AS i, true AS j, true AS k, true AS l, 2 AS m, '2,3' AS n")
_c("fn_string_arrays", "SELECT p_partkey, array_to_string(string_to_array(p_type, ' '), '/') AS a, cardinality(string_to_array(p_type, ' ')) AS n, array_dims(string_to_array(p_type, ' ')) AS d FROM part", "SELECT p_partkey, replace(p_type, ' ', '/') AS a, len(string_split(p_type, ' ')) AS n, '[1:' || len(string_split(p_type, ' ')) || ']' AS d FROM part")
_c("fn_json_extract", "SELECT event_id, props ->> 'k' AS a, json_typeof(props) AS t, props IS JSON AS j FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS a, lower(json_type(props)) AS t, json_valid(props) AS j FROM events")
_c("fn_json_edit", """SELECT jsonb_set('{"a":{"b":1}}', '{a,b}', '2') AS a, jsonb_strip_nulls('{"a":null,"b":1}') AS b, '{"a":1,"b":2}' #- '{a}'::text[] AS c, jsonb_insert('{"a":[0,1]}', '{a,1}', '9') AS d, jsonb_concat('{"a":1}', '{"b":2}') AS e, jsonb_contains('{"a":1,"b":[1,2]}', '{"b":[2]}') AS f, jsonb_exists('{"a":1}', 'a') AS g, json_array_length('[1,2,3]') AS h, jsonb_path_query_array('{"a":[1,2,3]}', '$.a[*] ? (@ > 1)') AS i, jsonb_path_exists('{"a":5}', '$.a ? (@ > 6)') AS j, '{"a":{"c":[7,8]}}' #>> '{a,c,1}'::text[] AS k""",
   """SELECT '{"a":{"b":2}}' AS a, '{"b":1}' AS b, '{"b":2}' AS c, '{"a":[0,9,1]}' AS d, '{"a":1,"b":2}' AS e, true AS f, true AS g, 3 AS h, '[2,3]' AS i, false AS j, '8' AS k""")
_c("fn_json_build", "SELECT n_nationkey, json_build_object('k', n_nationkey, 'n', n_name) AS a, json_build_array(n_nationkey, n_name, NULL) AS b FROM nation", "SELECT n_nationkey, CAST(json_object('k', n_nationkey, 'n', n_name) AS VARCHAR) AS a, CAST(json_array(n_nationkey, n_name, NULL) AS VARCHAR) AS b FROM nation")
_c("fn_json_each", """SELECT j.key, j.value FROM json_each_text('{"a":"x","b":"y"}') AS j(key, value)""", "SELECT * FROM (VALUES ('a', 'x'), ('b', 'y')) t(key, value)")
_c("fn_json_elements", "SELECT e.x FROM json_array_elements_text('[\"p\",\"q\"]') AS e(x)", "SELECT * FROM (VALUES ('p'), ('q')) t(x)")
_c("fn_json_agg", "SELECT n_regionkey, json_agg(n_nationkey ORDER BY n_nationkey) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS j FROM nation GROUP BY n_regionkey")
_c("fn_ranges", "SELECT n_nationkey, range_contains_elem(int4range(5, 12), n_nationkey) AS a, range_overlaps(int4range(n_nationkey, n_nationkey + 3), int4range(10, 12, '[]')) AS b, range_adjacent(int4range(1, 5), int4range(5, 8)) AS c, isempty(int4range(3, 3)) AS d, range_merge(int4range(1, 3), int4range(7, 9)).upper AS e, range_intersect(numrange(1.0, 5.0), numrange(3.0, 8.0)).lower AS f FROM nation",
   "SELECT n_nationkey, n_nationkey >= 5 AND n_nationkey < 12 AS a, n_nationkey < 13 AND n_nationkey + 3 > 10 AS b, true AS c, true AS d, 9 AS e, 3.0 AS f FROM nation")
_c("fn_range_agg", "SELECT n_regionkey, size(range_agg(int4range(n_nationkey, n_nationkey + 2))) AS n FROM nation GROUP BY n_regionkey",
   "WITH o AS (SELECT n_regionkey, n_nationkey, lag(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS p FROM nation) SELECT n_regionkey, count(*) FILTER (WHERE p IS NULL OR n_nationkey > p + 2) AS n FROM o GROUP BY n_regionkey")
_c("fn_conversions", "SELECT tointeger('42') AS a, tofloat('1.5') AS b, toboolean('true') AS c, tostring(7) AS d, tointegerornull('x') IS NULL AS e, pg_size_pretty(CAST(20480 AS BIGINT)) AS f, pg_typeof(1) AS g, '12'::int4 + 1 AS h", "SELECT 42 AS a, 1.5 AS b, true AS c, '7' AS d, true AS e, '20 kB' AS f, 'integer' AS g, 13 AS h")
_c("fn_network", "SELECT host('192.168.1.5/24') AS a, masklen('192.168.1.5/24') AS b, broadcast('192.168.1.5/24') AS c, network('192.168.1.5/24') AS d, inet_merge('192.168.1.5/24', '192.168.2.5/24') AS e", "SELECT '192.168.1.5' AS a, 24 AS b, '192.168.1.255/24' AS c, '192.168.1.0/24' AS d, '192.168.0.0/22' AS e")
_c("fn_geometry", "SELECT area(box(point(0, 0), point(2, 3))) AS a, point_distance(point(0, 0), point(3, 4)) AS b, diameter(circle(point(0, 0), 2)) AS c, npoints(ARRAY[point(1, 1), point(2, 2)]) AS d", "SELECT 6.0 AS a, 5.0 AS b, 4.0 AS c, 2 AS d")
_c("fn_xml", "SELECT xmlelement('b', 'x<y') AS a, xmlcomment('c') AS b, xml_is_well_formed('<a/>') AS c, xpath_exists('/a/b', '<a><b>1</b></a>') AS d", "SELECT '<b>x&lt;y</b>' AS a, '<!--c-->' AS b, true AS c, true AS d")
_c("fn_fulltext", "SELECT to_tsvector('english', 'The cats are running') AS a, to_tsquery('english', 'cat & run') AS b, to_tsvector('Fat cats ran') @@ to_tsquery('cat & !dog') AS c, phraseto_tsquery('big cats') AS d, websearch_to_tsquery('cats -dogs') AS e, ts_headline('my cat sat', to_tsquery('cat')) AS f", "SELECT '''cat'':2 ''run'':4' AS a, '''cat'' & ''run''' AS b, true AS c, '''big'' <-> ''cat''' AS d, '''cat'' & !''dog''' AS e, 'my <b>cat</b> sat' AS f")
