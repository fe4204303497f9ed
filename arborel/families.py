"""One query for each family of constructors and functions, over whole tables, with SQL of the same result."""

from __future__ import annotations

_T = "TIMESTAMP '1990-01-01'"
#: Seconds with their fraction, as the string value of a time shows them.
_CLOCK = "rtrim(rtrim(strftime(ts, '%H:%M:%S.%f'), '0'), '.')"
_STAMP = "rtrim(rtrim(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '0'), '.')"

#: name -> (expression over tables, SQL with the same columns)
TABLE_FAMILIES: dict[str, tuple[str, str]] = {
    # constructors
    "xp_string_kinds": (
        "/nation/row ! map{'k': n_nationkey, 'ns': xs:normalizedString(concat(n_name, codepoints-to-string(9), 'x')), 'tk': xs:token(concat('  ', n_name, '   x ')),"
        " 'la': xs:language(lower-case(substring(n_name, 1, 2))), 'nt': xs:NMTOKEN(concat(n_nationkey, '-a')), 'nm': xs:Name(concat('_:', n_name)), 'nc': xs:NCName(concat('_', n_name)),"
        " 'id': xs:ID(n_name), 'ir': xs:IDREF(n_name), 'en': xs:ENTITY(n_name), 'au': xs:anyURI(concat(' http://x/', n_name, ' ')), 'ua': xs:untypedAtomic(n_name), 's': xs:string(n_nationkey)}",
        "SELECT n_nationkey::BIGINT AS k, n_name || ' x' AS ns, n_name || ' x' AS tk, lower(substr(n_name, 1, 2)) AS la, n_nationkey || '-a' AS nt, '_:' || n_name AS nm, '_' || n_name AS nc,"
        " n_name AS id, n_name AS ir, n_name AS en, 'http://x/' || n_name AS au, n_name AS ua, n_nationkey::VARCHAR AS s FROM nation",
    ),
    "xp_string_castable": (
        "/nation/row ! map{'k': n_nationkey, 'nc': concat(n_nationkey, 'a') castable as xs:NCName, 'nt': concat(n_nationkey, 'a') castable as xs:NMTOKEN, 'la': n_name castable as xs:language,"
        " 'nm': concat(':', n_name) castable as xs:Name, 'id': concat(n_name, ' x') castable as xs:ID, 'q': concat('xs:', n_name) castable as xs:QName}",
        "SELECT n_nationkey::BIGINT AS k, false AS nc, true AS nt, false AS la, true AS nm, false AS id, true AS q FROM nation",
    ),
    "xp_integer_kinds": (
        "/part/row ! map{'k': p_partkey, 'nn': xs:nonNegativeInteger(p_size), 'po': xs:positiveInteger(p_size), 'np': xs:nonPositiveInteger(-p_size), 'ne': xs:negativeInteger(-p_size), 'lo': xs:long(p_size),"
        " 'in': xs:int(string(p_size)), 'sh': xs:short(p_size), 'by': xs:byte(p_size), 'ul': xs:unsignedLong(p_size), 'ui': xs:unsignedInt(string(p_size)), 'us': xs:unsignedShort(p_size), 'ub': xs:unsignedByte(p_size), 'it': xs:integer(string(p_size))}",
        "SELECT p_partkey AS k, p_size::BIGINT AS nn, p_size::BIGINT AS po, -p_size::BIGINT AS np, -p_size::BIGINT AS ne, p_size::BIGINT AS lo, p_size::BIGINT AS in, p_size::BIGINT AS sh, p_size::BIGINT AS by,"
        " p_size::BIGINT AS ul, p_size::BIGINT AS ui, p_size::BIGINT AS us, p_size::BIGINT AS ub, p_size::BIGINT AS it FROM part".replace("AS in,", 'AS "in",').replace("AS by,", 'AS "by",'),
    ),
    "xp_integer_castable": (
        "/part/row ! map{'k': p_partkey, 'by': (p_size * 10) castable as xs:byte, 'ub': (p_size * 10) castable as xs:unsignedByte, 'sh': (p_size * 1000) castable as xs:short, 'us': (p_size * 2000) castable as xs:unsignedShort,"
        " 'in': (p_size * 100000000) castable as xs:int, 'ui': (p_size * 100000000) castable as xs:unsignedInt, 'po': (p_size - 25) castable as xs:positiveInteger, 'nn': (p_size - 25) castable as xs:nonNegativeInteger,"
        " 'ne': (p_size - 25) castable as xs:negativeInteger, 'np': (p_size - 25) castable as xs:nonPositiveInteger, 'ul': (p_size - 25) castable as xs:unsignedLong, 'lo': concat(p_size, '000000000000000000') castable as xs:long}",
        "SELECT p_partkey AS k, p_size * 10 <= 127 AS \"by\", p_size * 10 <= 255 AS ub, p_size * 1000 <= 32767 AS sh, p_size * 2000 <= 65535 AS us, p_size::BIGINT * 100000000 <= 2147483647 AS \"in\","
        " p_size::BIGINT * 100000000 <= 4294967295 AS ui, p_size > 25 AS po, p_size >= 25 AS nn, p_size < 25 AS ne, p_size <= 25 AS np, p_size >= 25 AS ul, p_size <= 9 AS lo FROM part",
    ),
    "xp_number_kinds": (
        "/part/row ! map{'k': p_partkey, 'd': string(xs:decimal(concat(p_size, '.50'))), 'f': xs:double(xs:float(p_size)), 'e': xs:double(concat(p_size, 'e1')), 'n': xs:numeric(p_size), 'b': xs:boolean(string(p_size mod 2)), 'i': string(xs:double('INF'))}",
        "SELECT p_partkey AS k, p_size || '.5' AS d, p_size::DOUBLE AS f, p_size * 10::DOUBLE AS e, p_size::DOUBLE AS n, p_size % 2 = 1 AS b, 'INF' AS i FROM part",
    ),
    "xp_partial_dates": (
        "/orders/row ! map{'k': o_orderkey, 'y': string(xs:gYear(xs:date(o_orderdate))), 'ym': string(xs:gYearMonth(o_orderdate)), 'm': string(xs:gMonth(o_orderdate)), 'md': string(xs:gMonthDay(xs:date(o_orderdate))), 'd': string(xs:gDay(o_orderdate))}",
        "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%Y-%m') AS ym, strftime(o_orderdate, '--%m') AS m, strftime(o_orderdate, '--%m-%d') AS md, strftime(o_orderdate, '---%d') AS d FROM orders",
    ),
    "xp_date_kinds": (
        "/events/row ! map{'k': event_id, 'dt': string(xs:dateTime(string(ts))), 't': string(xs:time(ts)), 'd': string(xs:date(string(xs:date(ts)))), 'st': string(xs:dateTimeStamp(concat(ts, 'Z'))),"
        " 'c': concat(ts, '') castable as xs:dateTimeStamp, 'j': string(dateTime(xs:date(ts), xs:time(ts)))}",
        f"SELECT event_id AS k, {_STAMP} AS dt, {_CLOCK} AS t, strftime(ts, '%Y-%m-%d') AS d, {_STAMP} || 'Z' AS st, false AS c, {_STAMP} AS j FROM events",
    ),
    "xp_duration_kinds": (
        "/part/row ! map{'k': p_partkey, 'ym': string(xs:yearMonthDuration(concat('P', p_size, 'M'))), 'dt': string(xs:dayTimeDuration(concat('PT', p_size, 'H'))), 'du': string(xs:duration(concat('P', p_size, 'YT1S'))), 'y': years-from-duration(xs:yearMonthDuration(concat('P', p_size, 'M'))), 'm': months-from-duration(xs:yearMonthDuration(concat('P', p_size, 'M')))}",
        "SELECT p_partkey AS k, 'P' || CASE WHEN p_size >= 12 THEN (p_size // 12) || 'Y' ELSE '' END || CASE WHEN p_size % 12 > 0 THEN (p_size % 12) || 'M' ELSE '' END AS ym,"
        " 'P' || CASE WHEN p_size >= 24 THEN (p_size // 24) || 'D' ELSE '' END || CASE WHEN p_size % 24 > 0 THEN 'T' || (p_size % 24) || 'H' ELSE '' END AS dt, 'P' || p_size || 'YT1S' AS du, (p_size // 12)::BIGINT AS y, (p_size % 12)::BIGINT AS m FROM part",
    ),
    "xp_binary_kinds": (
        "/part/row ! map{'k': p_partkey, 'h': string(xs:hexBinary(format-integer(p_partkey, '00000000'))), 'b': string(xs:base64Binary(xs:hexBinary(format-integer(p_partkey, '00000000')))), 'r': string(xs:hexBinary(xs:base64Binary('aGVsbG8=')))}",
        "SELECT p_partkey AS k, lpad(p_partkey::VARCHAR, 8, '0') AS h, base64(unhex(lpad(p_partkey::VARCHAR, 8, '0'))) AS b, '68656C6C6F' AS r FROM part",
    ),
    "xp_list_kinds": (
        "/nation/row ! map{'k': n_nationkey, 'n': count(xs:NMTOKENS(concat(n_nationkey, ' ', n_regionkey))), 'i': string-join(xs:IDREFS(concat(n_name, '  b')), '/'), 'e': count(xs:ENTITIES('a b c'))}",
        "SELECT n_nationkey::BIGINT AS k, 2 AS n, n_name || '/b' AS i, 3 AS e FROM nation",
    ),
    "xp_qnames": (
        "/nation/row ! map{'k': n_nationkey, 'p': prefix-from-QName(QName('http://x', concat('p:', n_name))), 'l': local-name-from-QName(QName('http://x', concat('p:', n_name))), 'u': string(namespace-uri-from-QName(QName(concat('http://x/', n_regionkey), n_name))),"
        " 'x': string(namespace-uri-from-QName(xs:QName(concat('xs:', n_name)))), 'e': QName('http://x', concat('p:', n_name)) eq QName('http://x', concat('q:', n_name)), 'n': local-name-from-QName(xs:NOTATION(concat('xs:', n_name)))}",
        "SELECT n_nationkey::BIGINT AS k, 'p' AS p, n_name AS l, 'http://x/' || n_regionkey AS u, 'http://www.w3.org/2001/XMLSchema' AS x, true AS e, n_name AS n FROM nation",
    ),
    # numbers
    "xp_trigonometry": (
        "/part/row ! map{'k': p_partkey, 'si': round(math:sin(p_size) * 1e6), 'co': round(math:cos(p_size) * 1e6), 'ta': round(math:tan(p_size div 50) * 1e6), 'as': round(math:asin(p_size div 50) * 1e6), 'ac': round(math:acos(p_size div 50) * 1e6),"
        " 'at': round(math:atan(p_size) * 1e6), 'a2': round(math:atan2(p_size, 7) * 1e6), 'pi': round(math:pi() * 1e6), 'ex': round(math:exp(p_size div 10) * 1e6), 'et': round(math:exp10(p_size div 10) * 1e3), 'lo': round(math:log(p_size) * 1e6)}",
        "SELECT p_partkey AS k, floor(sin(p_size) * 1e6 + 0.5) AS si, floor(cos(p_size) * 1e6 + 0.5) AS co, floor(tan(p_size / 50) * 1e6 + 0.5) AS ta, floor(asin(p_size / 50) * 1e6 + 0.5) AS \"as\", floor(acos(p_size / 50) * 1e6 + 0.5) AS ac,"
        " floor(atan(p_size) * 1e6 + 0.5) AS \"at\", floor(atan2(p_size, 7) * 1e6 + 0.5) AS a2, floor(pi() * 1e6 + 0.5) AS pi, floor(exp(p_size / 10) * 1e6 + 0.5) AS ex, floor(pow(10, p_size / 10) * 1e3 + 0.5) AS et, floor(ln(p_size) * 1e6 + 0.5) AS lo FROM part",
    ),
    "xp_number_functions": (
        "/part/row ! map{'k': p_partkey, 'n': number(concat(p_size, '.5')), 'x': string(number(p_brand)), 'h': string(round-half-to-even(xs:decimal(p_size) div 2)), 'f': format-number(p_size * 1000.5, '#,##0.00'), 'r': random-number-generator(p_size)?number lt 1}",
        "SELECT p_partkey AS k, p_size + 0.5::DOUBLE AS n, 'NaN' AS x, (CASE WHEN p_size % 4 = 1 THEN p_size // 2 WHEN p_size % 2 = 1 THEN p_size // 2 + 1 ELSE p_size // 2 END)::VARCHAR AS h,"
        " format('{:,.2f}', p_size * 1000.5::DOUBLE) AS f, true AS r FROM part",
    ),
    # booleans, sequences
    "xp_booleans": (
        "/part/row ! map{'k': p_partkey, 't': true(), 'f': false(), 'b': boolean(p_name), 'n': not(p_size gt 10), 'tr': trace(p_size, 'size'), 'e': empty(()), 'x': exists((p_size, 1)), 'a': (let $p := p_size return empty((1, 2)[. gt $p]))}",
        "SELECT p_partkey AS k, true AS t, false AS f, true AS b, p_size <= 10 AS n, p_size::BIGINT AS tr, true AS e, true AS x, p_size >= 2 AS a FROM part",
    ),
    "xp_sequences": (
        "/part/row ! map{'k': p_partkey, 'i': string-join(for $x in insert-before((1, p_size), 2, 9) return string($x), ','), 'r': string-join(for $x in remove((1, p_size, 3), 1) return string($x), ','), 't': sum(tail((1, p_size, 3))), 'u': sum(unordered((1, p_size))),"
        " 'z': zero-or-one(p_size), 'o': count(one-or-more((1, p_size))), 'e': exactly-one(p_size), 'd': deep-equal((1, p_size), (1, 5)), 'h': head((p_size, 7)), 's': sum(sort((3, p_size, 1))[position() le 2])}",
        "SELECT p_partkey AS k, '1,9,' || p_size AS i, p_size || ',3' AS r, p_size::BIGINT + 3 AS t, p_size::BIGINT + 1 AS u, p_size::BIGINT AS z, 2::BIGINT AS o, p_size::BIGINT AS e, p_size = 5 AS d, p_size::BIGINT AS h, (1 + least(p_size, 3))::BIGINT AS s FROM part",
    ),
    "xp_typing": (
        "/part/row ! map{'k': p_partkey, 'i': p_size instance of item(), 'e': () instance of empty-sequence(), 'n': (p_size, 1) instance of empty-sequence(), 's': (p_size, 1) instance of xs:integer+, 'd': p_size instance of xs:decimal, 't': (p_size treat as xs:integer) + 1,"
        " 'm': map{'a': p_size} instance of map(*), 'a': [p_size] instance of array(*), 'c': array{p_size, 2}?2, 'x': data([p_size])}",
        "SELECT p_partkey AS k, true AS i, true AS e, false AS n, true AS s, true AS d, p_size::BIGINT + 1 AS t, true AS m, true AS a, 2::BIGINT AS c, [p_size::BIGINT] AS x FROM part",
    ),
    # strings
    "xp_string_functions": (
        "/customer/row ! map{'k': c_custkey, 'cc': concat(c_name, '/', c_mktsegment), 'ce': codepoint-equal(c_mktsegment, 'BUILDING'), 'cp': codepoints-to-string((65, 66 + c_nationkey)), 'nu': normalize-unicode(concat(c_name, codepoints-to-string((101, 769)))),"
        " 'ct': contains-token(concat(' a ', c_mktsegment, ' b'), 'BUILDING'), 'ck': collation-key(c_name) eq collation-key(c_name), 'dc': default-collation(), 'dl': default-language(), 'sb': empty(static-base-uri())}",
        "SELECT c_custkey AS k, c_name || '/' || c_mktsegment AS cc, c_mktsegment = 'BUILDING' AS ce, 'A' || chr(66 + c_nationkey) AS cp, c_name || 'é' AS nu, c_mktsegment = 'BUILDING' AS ct, true AS ck,"
        " 'http://www.w3.org/2005/xpath-functions/collation/codepoint' AS dc, 'en' AS dl, true AS sb FROM customer",
    ),
    "xp_uris": (
        "/pages/row ! map{'k': page_id, 'i': iri-to-uri(concat(url, ' é<')), 'h': escape-html-uri(concat(url, ' é')), 'r': string(resolve-uri(concat('p', page_id), 'http://x/a/b')), 'e': encode-for-uri(concat(page_id, '/é ~'))}",
        "SELECT page_id AS k, url || '%20%C3%A9%3C' AS i, url || ' %C3%A9' AS h, 'http://x/a/p' || page_id AS r, page_id || '%2F%C3%A9%20~' AS e FROM pages",
    ),
    "xp_regular_expressions": (
        "/pages/row ! map{'k': page_id, 'n': replace(url, '[a\\D]', ''), 'd': count(tokenize(url, '[/:?#]+')), 'm': matches(url, '^[\\i-[hq]]'), 'a': count(analyze-string(url, '[0-9]+')), 'c': matches(url, 'EXAMPLE', 'i')}",
        "SELECT page_id AS k, regexp_replace(url, '[^0-9]', '', 'g') AS n, len(regexp_split_to_array(url, '[/:?#]+')) AS d, NOT starts_with(url, 'h') AS m,"
        " len(regexp_extract_all(url, '[0-9]+')) + len(regexp_extract_all(url, '[^0-9]+')) AS a, regexp_matches(url, 'example', 'i') AS c FROM pages",
    ),
    # dates and durations
    "xp_dateTime_parts": (
        "/events/row ! map{'k': event_id, 'h': hours-from-dateTime(ts), 'm': minutes-from-dateTime(ts), 's': xs:integer(seconds-from-dateTime(ts) * 1000000), 'z': string(timezone-from-dateTime(adjust-dateTime-to-timezone(ts, xs:dayTimeDuration('PT5H')))), 'n': empty(timezone-from-dateTime(ts)),"
        " 'th': hours-from-time(xs:time(ts)), 'tm': minutes-from-time(xs:time(ts)), 'ts': xs:integer(seconds-from-time(xs:time(ts)) * 1000000), 'tz': empty(timezone-from-time(xs:time(ts))),"
        " 'dy': year-from-date(xs:date(ts)), 'dm': month-from-date(xs:date(ts)), 'dd': day-from-date(xs:date(ts)), 'dz': empty(timezone-from-date(xs:date(ts)))}",
        "SELECT event_id AS k, hour(ts) AS h, minute(ts) AS m, microsecond(ts) AS s, 'PT5H' AS z, true AS n, hour(ts) AS th, minute(ts) AS tm, microsecond(ts) AS ts, true AS tz, year(ts) AS dy, month(ts) AS dm, day(ts) AS dd, true AS dz FROM events",
    ),
    "xp_timezones": (
        "/events/row ! map{'k': event_id, 'a': string(adjust-dateTime-to-timezone(xs:dateTime(concat(ts, 'Z')), xs:dayTimeDuration('PT5H'))), 'd': string(adjust-date-to-timezone(xs:date(ts), xs:dayTimeDuration('PT5H'))),"
        " 't': string(adjust-time-to-timezone(xs:time(ts), xs:dayTimeDuration('-PT3H'))), 'i': string(implicit-timezone()), 'c': current-dateTime() gt xs:dateTime('2020-01-01T00:00:00Z'), 'cd': current-date() gt xs:date('2020-01-01'), 'ct': current-time() instance of xs:time}",
        f"SELECT event_id AS k, {_STAMP.replace('ts', 'ts + INTERVAL 5 HOUR')} || '+05:00' AS a, strftime(ts, '%Y-%m-%d') || '+05:00' AS d, {_CLOCK} || '-03:00' AS t, 'PT0S' AS i, true AS c, true AS cd, true AS ct FROM events",
    ),
    "xp_duration_parts": (
        "/events/row ! map{'k': event_id, 'd': days-from-duration(ts - xs:dateTime('1990-01-01T00:00:00')), 'h': hours-from-duration(ts - xs:dateTime('1990-01-01T00:00:00')), 'm': minutes-from-duration(ts - xs:dateTime('1990-01-01T00:00:00')), 's': xs:integer(seconds-from-duration(ts - xs:dateTime('1990-01-01T00:00:00')) * 1000000)}",
        f"SELECT event_id AS k, date_diff('day', {_T}, date_trunc('day', ts)) AS d, hour(ts) AS h, minute(ts) AS m, microsecond(ts) AS s FROM events",
    ),
    "xp_date_pictures": (
        "/events/row ! map{'k': event_id, 'd': format-date(xs:date(ts), '[D01].[M01].[Y0001]'), 't': format-time(xs:time(ts), '[H01]:[m01]:[s01]'), 'l': format-dateTime(ts, '[MNn] [D1o], [Y]'), 'w': format-date(xs:date(ts), '[FNn]'),"
        " 'p': string(parse-ietf-date(format-dateTime(ts, '[D] [MNn,3-3] [Y] [H01]:[m01]:[s01] GMT')))}",
        "SELECT event_id AS k, strftime(ts, '%d.%m.%Y') AS d, strftime(ts, '%H:%M:%S') AS t, strftime(ts, '%B ') || day(ts) || CASE WHEN day(ts) IN (1, 21, 31) THEN 'st' WHEN day(ts) IN (2, 22) THEN 'nd' WHEN day(ts) IN (3, 23) THEN 'rd' ELSE 'th' END || strftime(ts, ', %Y') AS l,"
        " strftime(ts, '%A') AS w, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS p FROM events",
    ),
    # functions, maps, arrays
    "xp_function_items": (
        "/part/row ! map{'k': p_partkey, 'p': concat('x', ?)(p_name), 'r': (let $f := abs#1 return $f(-p_size)), 'n': function-arity(concat('x', ?)), 'q': string(function-name(abs#1)), 'l': function-lookup('abs', 1)(-p_size), 'a': apply(concat#2, ['a', p_name]),"
        " 'fr': fold-right((1, 2, p_size), 0, function($a, $b) { $a - $b }), 'fp': sum(for-each-pair((1, p_size), (4, 5), function($a, $b) { $a * $b })), 'c': (function($x as xs:double) as xs:double { $x * 2 })(p_size), 'cl': (let $y := p_size return for-each((1, 2), function($x) { $x + $y }))[2]}",
        "SELECT p_partkey AS k, 'x' || p_name AS p, p_size::BIGINT AS r, 1::BIGINT AS n, 'abs' AS q, p_size::BIGINT AS l, 'a' || p_name AS a, 1 - (2 - p_size::BIGINT) AS fr, 4 + 5 * p_size::BIGINT AS fp, p_size * 2::DOUBLE AS c, [2 + p_size::BIGINT] AS cl FROM part",
    ),
    "xp_maps": (
        "/part/row ! map{'k': p_partkey, 'ks': string-join(map:keys(map{'a': p_size, 'b': 2}), ','), 'r': map:size(map:remove(map{'a': p_size, 'b': 2}, 'a')), 'e': map:get(map:entry('a', p_size), 'a'), 'm': map:get(map:merge((map{'a': p_size}, map{'a': 2, 'c': 3})), 'a'),"
        " 'l': map:get(map:merge((map{'a': 1}, map{'a': p_size}), map{'duplicates': 'use-last'}), 'a'), 'f': array:size(map:find([map{'b': 1}, map{'b': p_size}], 'b')), 'x': sum(map:for-each(map{'a': p_size}, function($k, $v) { $v + 1 })), 'q': map{'a': p_size, 'b': 7}?b}",
        "SELECT p_partkey AS k, 'a,b' AS ks, 1 AS r, p_size::BIGINT AS e, p_size::BIGINT AS m, p_size::BIGINT AS l, 2 AS f, p_size::BIGINT + 1 AS x, 7::BIGINT AS q FROM part",
    ),
    "xp_array_functions": (
        "/embeddings/row ! map{'k': vec_id, 'p': xs:double(array:get(array:put(embedding, 1, 7), 1)), 'i': array:size(array:insert-before(embedding, 1, 0)), 'a': array:size(array:append(embedding, 0)), 'r': array:size(array:remove(embedding, 1)), 's': xs:double(array:head(array:subarray(embedding, 2))), 't': xs:double(array:head(array:tail(embedding))),"
        " 'v': xs:double(array:head(array:reverse(embedding))), 'j': array:size(array:join((embedding, embedding))), 'o': xs:double(array:head(array:sort(embedding))), 'fl': array:fold-left(embedding, 0, function($x, $y) { $x + 1 }), 'fr': array:fold-right(embedding, 0, function($x, $y) { $y + 1 }),"
        " 'fp': array:size(array:for-each-pair(embedding, array:tail(embedding), function($x, $y) { $x * $y }))}",
        "SELECT vec_id AS k, 7::DOUBLE AS p, len(embedding) + 1 AS i, len(embedding) + 1 AS a, len(embedding) - 1 AS r, embedding[2]::DOUBLE AS s, embedding[2]::DOUBLE AS t, embedding[len(embedding)]::DOUBLE AS v, len(embedding) * 2 AS j, list_min(embedding)::DOUBLE AS o,"
        " len(embedding) AS fl, len(embedding) AS fr, len(embedding) - 1 AS fp FROM embeddings",
    ),
    "xp_json_forms": (
        "/events/row ! map{'k': event_id, 'x': xml-to-json(json-to-xml(props)), 's': serialize(map{'a': event_id}, map{'method': 'json'}), 'a': parse-json(concat('[1, ', event_id, ']'))?2 = event_id}",
        "SELECT event_id AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS x, '{\"a\":' || event_id || '}' AS s, true AS a FROM events",
    ),
    "xp_comments": ("/region/row(: all of them :) ! (r_regionkey (: the key (: nested :) :) + 1)", "SELECT r_regionkey::BIGINT + 1 AS value FROM region"),
    "xp_names_as_operators": ("/part/row[p_size mod 2 = 1 and p_size div 2 gt 3]/p_partkey", "SELECT p_partkey AS value FROM part WHERE p_size % 2 = 1 AND p_size / 2 > 3"),
}

#: A customer as an XML document; the nodes in order are numbered in PRE.
XML = (
    "<c:customer xmlns=\"http://d\" xmlns:c=\"http://c\" xml:lang=\"en-US\" xml:id=\"c{c_custkey}\" key=\"{c_custkey}\" nation=\"{c_nationkey}\"><!--note {c_custkey}-->"
    "<name>{c_name}</name><?pi v{c_custkey}?><c:code>{c_nationkey}</c:code><ref to=\"c{c_custkey}\"/><empty/></c:customer>"
)
PRE = {"customer": 1, "lang": 2, "id": 3, "key": 4, "nation": 5, "comment": 6, "name": 7, "name text": 8, "pi": 9, "code": 10, "code text": 11, "ref": 12, "to": 13, "empty": 14}
NAMESPACES = (("c", "http://c"), ("d", "http://d"))


def _nodes(*names: str, where: str = "true") -> str:
    """SQL of these nodes of each customer's document."""
    return f"SELECT c_custkey AS doc_id, unnest([{', '.join(str(PRE[n]) for n in names)}])::BIGINT AS pre FROM customer WHERE {where}"


def _values(values: dict[str, str]) -> str:
    """SQL of a value for each of these nodes; a value is SQL over customer."""
    return " UNION ALL ".join(f"SELECT c_custkey AS doc_id, {PRE[n]}::BIGINT AS \"of\", {v} AS value FROM customer" for n, v in values.items())


def _one(value: str) -> str:
    return f"SELECT c_custkey AS doc_id, {value} AS value FROM customer"


#: name -> (expression over the documents of customers, SQL): nodes as (doc_id, pre), else (doc_id, value) or (doc_id, of, value)
TREE_FAMILIES: dict[str, tuple[str, str]] = {
    "xp_tree_attribute": ("/c:customer[@nation = '3']/@key", _nodes("key", where="c_nationkey = 3")),
    "xp_tree_attributes": ("//@*", _nodes("lang", "id", "key", "nation", "to")),
    "xp_tree_attribute_axis": ("/*/attribute::nation[. > 10]", _nodes("nation", where="c_nationkey > 10")),
    "xp_tree_node": ("/*/node()", _nodes("comment", "name", "pi", "code", "ref", "empty")),
    "xp_tree_text": ("//text()", _nodes("name text", "code text")),
    "xp_tree_comment": ("//comment()", _nodes("comment")),
    "xp_tree_pi": ("//processing-instruction('pi')", _nodes("pi")),
    "xp_tree_element": ("//element(c:code) | //element()[. = '']", _nodes("code", "ref", "empty")),
    "xp_tree_document_node": ("exists(/self::document-node())", _one("true")),
    "xp_tree_wildcards": ("//c:* | //*:name", _nodes("customer", "code", "name")),
    "xp_tree_braced": ("//Q{http://d}name | //Q{http://c}code", _nodes("name", "code")),
    "xp_tree_is": ("//d:name[. is /c:customer/d:name]", _nodes("name")),
    "xp_tree_before": ("//*[. << //c:code]", _nodes("customer", "name")),
    "xp_tree_after": ("/*/*[. >> //c:code]", _nodes("ref", "empty")),
    "xp_tree_namespaces": ("count(/*/namespace::*)", _one("3::BIGINT")),
    "xp_tree_namespace_nodes": ("count(/*/namespace::namespace-node())", _one("3::BIGINT")),
    "xp_tree_name": ("for $x in //* return name($x)", _values({"customer": "'c:customer'", "name": "'name'", "code": "'c:code'", "ref": "'ref'", "empty": "'empty'"})),
    "xp_tree_local_name": ("for $x in //@* return local-name($x)", _values({"lang": "'lang'", "id": "'id'", "key": "'key'", "nation": "'nation'", "to": "'to'"})),
    "xp_tree_namespace_uri": ("for $x in //* return string(namespace-uri($x))", _values({"customer": "'http://c'", "name": "'http://d'", "code": "'http://c'", "ref": "'http://d'", "empty": "'http://d'"})),
    "xp_tree_node_name": ("for $x in /*/@* return string(node-name($x))", _values({"lang": "'xml:lang'", "id": "'xml:id'", "key": "'key'", "nation": "'nation'"})),
    "xp_tree_nilled": ("for $x in /*/* return nilled($x)", _values({n: "false" for n in ("name", "code", "ref", "empty")})),
    "xp_tree_data": ("for $x in /* return data($x)", _values({"customer": "c_name || c_nationkey"})),
    "xp_tree_string": ("for $x in /*/* return string($x)", _values({"name": "c_name", "code": "c_nationkey::VARCHAR", "ref": "''", "empty": "''"})),
    "xp_tree_base_uri": ("for $x in /*/* return string(base-uri($x))", _values({n: "'http://x/' || c_custkey" for n in ("name", "code", "ref", "empty")})),
    "xp_tree_document_uri": ("string(document-uri(/))", _one("'http://x/' || c_custkey")),
    "xp_tree_root": ("for $x in //c:code return root($x)/c:customer/@key", f"SELECT c_custkey AS doc_id, {PRE['code']}::BIGINT AS \"of\", {PRE['key']}::BIGINT AS pre FROM customer"),
    "xp_tree_path": ("for $x in //d:name/text() return path($x)", _values({"name text": "'/Q{http://c}customer[1]/Q{http://d}name[1]/text()[1]'"})),
    "xp_tree_has_children": ("//*[has-children()]", _nodes("customer", "name", "code")),
    "xp_tree_generate_id": ("//*[generate-id(.) = generate-id(/c:customer/d:ref)]", _nodes("ref")),
    "xp_tree_lang": ("//*[lang('en')]", _nodes("customer", "name", "code", "ref", "empty")),
    "xp_tree_id": ("id(//@to)", _nodes("customer")),
    "xp_tree_element_with_id": ("element-with-id('c7')", _nodes("customer", where="c_custkey = 7")),
    "xp_tree_idref": ("idref(/c:customer/@xml:id)", _nodes("to")),
    "xp_tree_prefixes": ("for $x in //d:empty return count(in-scope-prefixes($x))", _values({"empty": "3::BIGINT"})),
    "xp_tree_uri_for_prefix": ("for $x in //c:code return string(namespace-uri-for-prefix('c', $x))", _values({"code": "'http://c'"})),
    "xp_tree_resolve_qname": ("for $x in //c:code return string(namespace-uri-from-QName(resolve-QName('c:x', $x)))", _values({"code": "'http://c'"})),
    "xp_tree_doc": ("doc('http://x/7')//d:name", _nodes("name", where="c_custkey = 7")),
    "xp_tree_doc_available": ("doc-available('http://x/7')", _one("EXISTS (SELECT 1 FROM customer WHERE c_custkey = 7)")),
    "xp_tree_collection": ("collection('http://x/')//c:code", _nodes("code")),
    "xp_tree_sum": ("sum(//c:code) + count(//@*)", _one("c_nationkey + 5::DOUBLE")),
    "xp_tree_conditional": ("if (//c:code > 12) then 'high' else 'low'", _one("CASE WHEN c_nationkey > 12 THEN 'high' ELSE 'low' END")),
    "xp_tree_deep_equal": ("deep-equal(//c:code, /c:customer/@nation)", _one("false")),
    "xp_tree_deep_equal_same": ("deep-equal((//d:ref | //d:empty), /c:customer/*[position() > 2])", _one("true")),
    "xp_tree_deep_equal_not": ("deep-equal(//d:ref, //d:empty)", _one("false")),
    "xp_tree_quantified": ("some $x in /*/* satisfies $x = '7'", _one("c_nationkey = 7")),
    "xp_tree_head": ("head(//*[. = ''])", _nodes("ref")),
    "xp_tree_tail": ("tail(//*[. = ''])", _nodes("empty")),
}

#: A schema of these documents.
XSD = (
    "<xs:schema xmlns:xs=\"http://www.w3.org/2001/XMLSchema\" xmlns:c=\"http://c\" targetNamespace=\"http://c\"><xs:simpleType name=\"code\"><xs:restriction base=\"xs:int\"><xs:minInclusive value=\"0\"/><xs:maxInclusive value=\"49\"/></xs:restriction></xs:simpleType>"
    "<xs:element name=\"code\" type=\"c:code\"/><xs:element name=\"customer\"/></xs:schema>"
)
