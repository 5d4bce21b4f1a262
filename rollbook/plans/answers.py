"""Registered queries of enrichment and reports, on a registry that is read off the driver's tables (see ``catalogue``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators import enrichment, execution, families, reports
from rollbook.plans.catalogue import _table, query

_DAY = "substr(cast(o_orderdate as string), 1, 10)"
_ACCOUNT = "lpad(cast({} as string), 10, '0')"
#: Columns of a full record, in SQL that both engines read.
FULL = {
    "id": "o_orderkey",
    "sheet_name": "case when o_orderkey % 11 = 0 then 'changes.xlsx :: Change of details' when o_orderkey % 11 = 1 then 'qtb.xlsx :: static_account_terminal' else 'master.xlsx :: ' || o_orderpriority end",
    "merchant_name": "case when o_orderkey % 13 = 0 then '' when o_orderkey % 17 = 0 then 'Branch of ' || n_name else c_name || case when o_orderkey % 3 = 0 then ' Ltd' else '' end end",
    "tid": "case when o_orderkey % 5 = 0 then '' else lpad(cast(o_custkey as string), 8, '0') end", "mxcode": "case when o_orderkey % 19 = 0 then '' else 'MX' || lpad(cast(o_custkey % 700 as string), 5, '0') end",
    "merchant_id": "'2ISW' || lpad(cast(o_custkey % 400 as string), 11, '0')", "payable_code": "lpad(cast(o_custkey * 2 + o_orderkey % 2 as string), 7, '0')", "alias": "lpad(cast(o_custkey % 1000 as string), 6, '0')",
    "email": "case when o_orderstatus = 'P' then '' else 'c' || cast(o_custkey as string) || '@example.com' end", "phone": "case when o_orderkey % 8 = 0 then null else '0800' || lpad(cast(o_custkey as string), 7, '0') end",
    "address": "case when o_orderkey % 4 = 0 then '' else cast(o_custkey % 90 as string) || ' Market ' || c_mktsegment || ' Road ' || n_name end", "contact_name": "'Contact ' || cast(o_custkey as string)", "account_name": "c_name",
    "account_number": f"case when o_orderkey % 10 = 0 then null else {_ACCOUNT.format('o_custkey + 1000000')} end", "static_acc_no": f"case when o_orderkey % 11 = 1 or o_orderkey % 23 = 0 then {_ACCOUNT.format('o_custkey * 3 + 5000000')} else '' end",
    "state": "n_name", "onboarded_date": f"case when o_orderkey % 6 = 0 then '' else {_DAY} end",
    "raw_data": "'{\"DEALER NAME\": \"' || c_name || '\", \"DEALER ACCOUNT NO\": \"' || " + _ACCOUNT.format("o_custkey") + " || '\"' || case when o_orderkey % 11 = 0 then ', \"OLD BANK ACC NO\": \"' || " + _ACCOUNT.format("o_orderkey") + " || '\", \"NEW BANK ACC NO\": \"' || " + _ACCOUNT.format("o_orderkey + 1") + " || '\", \"OLD BANK CODE\": \"057\", \"MONTH OF REQUEST\": \"' || " + _DAY + " || '\", \"NEW  MERCHANT ACCOUNT NAME\": \"New ' || c_name || '\"' else '' end || '}'",
}
_REG = f"reg AS (SELECT {', '.join(f'{e} AS {c}' for c, e in FULL.items())} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_ASKED = {
    "value": "case s_suppkey % 5 when 0 then replace(lpad(cast(s_suppkey * 3 as string), 8, '0'), '1', 'I') when 1 then 'mx' || lpad(cast(s_suppkey % 700 as string), 5, '0') when 2 then lpad(cast(s_suppkey + 1000000 as string), 10, '0') when 3 then 'C' || cast(s_suppkey as string) || '@example.com' else 'none ' || s_name end",
}
_WANTED = f"wanted AS (SELECT DISTINCT {_ASKED['value']} AS value FROM supplier)"
_COLUMNS = ("tid", "mxcode", "phone", "email", "account_number", "static_acc_no", "payable_code", "merchant_id", "alias")
_LOOK = "translate(upper(trim({})), '01258', 'OIZSB')"
_BEST = f"""cells AS (SELECT * FROM (SELECT id, unnest([{', '.join(f"'{c}'" for c in _COLUMNS)}]) AS field, upper(trim(unnest([{', '.join(_COLUMNS)}]))) AS cell FROM reg) WHERE coalesce(cell, '') <> ''),
    hits AS (SELECT value, id, field, cell = upper(trim(value)) AS same FROM cells JOIN wanted ON {_LOOK.format('cell')} = {_LOOK.format('value')}),
    best AS (SELECT value, arg_min(id, (NOT same, id, field)) AS id FROM hits GROUP BY value), res AS (SELECT value AS asked, reg.* FROM wanted LEFT JOIN best USING (value) LEFT JOIN reg USING (id))"""
_KEYED = """keyed AS (SELECT *, CASE WHEN tid <> '' THEN 'tid' WHEN mxcode <> '' THEN 'mxcode' ELSE 'merchant_id' END AS key_field, CASE WHEN tid <> '' THEN tid WHEN mxcode <> '' THEN mxcode ELSE merchant_id END AS terminal_key,
    [tid, mxcode, merchant_id, coalesce(account_number, '')] AS sig, upper(trim(merchant_name)) AS name, trim(split_part(sheet_name, '::', 1)) AS file, nullif(onboarded_date, '') AS day FROM reg)"""


def full(spark: SparkSession, d: str) -> DataFrame:
    joined = _table(spark, d, "orders").join(_table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).join(_table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    return joined.selectExpr(*[f"{e} as {c}" for c, e in FULL.items()])


def asked(spark: SparkSession, d: str) -> DataFrame:
    """A list of identifiers: one of each supplier, of four kinds and of none."""
    return _table(spark, d, "supplier").selectExpr(f"{_ASKED['value']} as value").distinct()


@query(f"""WITH {_REG}, {_KEYED}, bad AS (SELECT key_field, terminal_key FROM keyed WHERE name <> '' GROUP BY ALL HAVING count(DISTINCT sig) > 1),
    c AS (SELECT keyed.*, bad.key_field IS NOT NULL AS conflict FROM keyed LEFT JOIN bad USING (key_field, terminal_key)),
    cells AS (SELECT id, conflict, unnest(['phone', 'email', 'mxcode']) AS f, unnest([phone, email, mxcode]) AS v FROM c),
    smell AS (SELECT DISTINCT f, v FROM cells WHERE conflict AND coalesce(v, '') <> ''), shared AS (SELECT DISTINCT id FROM cells JOIN smell USING (f, v)),
    flagged AS (SELECT c.id, list_filter([CASE WHEN email = '' THEN 'missing_email' END, CASE WHEN phone IS NULL THEN 'missing_phone' END, CASE WHEN account_number IS NULL THEN 'missing_account' END, CASE WHEN address = '' THEN 'missing_address' END,
        CASE WHEN conflict THEN 'name_conflict' END, CASE WHEN shared.id IS NOT NULL THEN 'shared_identifier' END], lambda x: x IS NOT NULL) AS f FROM c LEFT JOIN shared USING (id))
    SELECT id, (100 - list_sum(list_prepend(0, list_transform(f, lambda x: CASE x WHEN 'missing_email' THEN 20 WHEN 'missing_phone' THEN 20 WHEN 'missing_account' THEN 15 WHEN 'name_conflict' THEN 15 ELSE 10 END))))::INT AS quality_score,
        array_to_string(f, ',') AS quality_flags FROM flagged""")
def quality_scores(spark, d):
    return enrichment.quality(full(spark, d)).select("id", "quality_score", F.array_join("quality_flags", ",").alias("quality_flags"))


@query(f"""WITH {_REG}, {_KEYED}, g AS (SELECT terminal_key, key_field, min(day) AS a, max(day) AS b, arg_min(file, id) AS fa, arg_max(file, id) AS fb FROM keyed GROUP BY ALL)
    SELECT terminal_key, key_field, 'first_seen' AS event_type, coalesce(a, 'unknown') AS value, fa AS source, 0::BIGINT AS n, a AS occurred_at FROM g
    UNION ALL SELECT terminal_key, key_field, 'last_seen', coalesce(b, 'unknown'), fb, 0, b FROM g
    UNION ALL SELECT terminal_key, key_field, 'name_variant', name, arg_min(file, id), count(*), NULL FROM keyed WHERE name <> '' GROUP BY terminal_key, key_field, name
    UNION ALL SELECT terminal_key, key_field, 'account_change', lpad(id::VARCHAR, 10, '0') || ' → ' || lpad((id + 1)::VARCHAR, 10, '0'), sheet_name, 0, json_extract_string(raw_data, '$."MONTH OF REQUEST"') FROM keyed WHERE id % 11 = 0""")
def merchant_events(spark, d):
    return enrichment.events(full(spark, d))


@query(f"""WITH {_REG}, {_KEYED} SELECT id, sheet_name, key_field, terminal_key, lpad(id::VARCHAR, 10, '0') AS old_account, lpad((id + 1)::VARCHAR, 10, '0') AS new_account, '057' AS old_bank, '' AS new_bank,
    json_extract_string(raw_data, '$."MONTH OF REQUEST"') AS occurred_at FROM keyed WHERE sheet_name LIKE '%Change%'""")
def account_changes(spark, d):
    return enrichment.account_changes(full(spark, d))


@query(f"""WITH {_REG}, {_KEYED} SELECT key_field, terminal_key FROM (SELECT DISTINCT 'tid' AS key_field, tid AS terminal_key, 0 AS r FROM reg WHERE tid <> '' AND (contains(tid, '0042') OR contains(upper(merchant_name), '0042'))
    UNION SELECT 'mxcode', mxcode, 1 FROM reg WHERE mxcode <> '' AND (contains(mxcode, '0042') OR contains(upper(merchant_name), '0042')) UNION SELECT 'merchant_id', merchant_id, 2 FROM reg WHERE contains(merchant_id, '0042') OR contains(upper(merchant_name), '0042')
    UNION SELECT 'account_number', account_number, 3 FROM reg WHERE account_number <> '' AND (contains(account_number, '0042') OR contains(upper(merchant_name), '0042'))) ORDER BY contains(terminal_key, '0042') DESC, r, terminal_key LIMIT 20""")
def timeline_keys(spark, d):
    return enrichment.keys_for(full(spark, d), "0042")


@query(f"""WITH {_REG}, {_WANTED}, {_BEST} SELECT asked AS identifier, coalesce(merchant_name, '') AS merchant, coalesce(email, '') AS answer, coalesce(tid, '') AS tid, coalesce(mxcode, '') AS mxcode, coalesce(sheet_name, '') AS sheet,
    CASE WHEN id IS NULL THEN 'not_found' ELSE 'no_name' END AS status FROM res""")
def email_answers(spark, d):
    return reports.field_report(full(spark, d), asked(spark, d), "email")


@query(f"""WITH {_REG}, {_WANTED}, {_BEST}, own AS (SELECT tid AS t, arg_min(payable_code, id) AS p FROM reg WHERE sheet_name LIKE '%static_account_terminal%' AND tid <> '' GROUP BY tid)
    SELECT asked AS identifier, coalesce(merchant_name, '') AS merchant, coalesce(p, payable_code, '') AS answer, coalesce(tid, '') AS tid, coalesce(mxcode, '') AS mxcode, coalesce(sheet_name, '') AS sheet,
    CASE WHEN id IS NULL THEN 'not_found' ELSE 'no_name' END AS status FROM res LEFT JOIN own ON t = upper(trim(asked))""")
def payable_answers(spark, d):
    return reports.field_report(full(spark, d), asked(spark, d), "payable_code")


@query(f"WITH {_REG}, {_WANTED}, {_BEST} SELECT asked AS identifier, {', '.join(f'''coalesce({c}, '') AS {c}''' for c in reports.PROFILE)}, CASE WHEN id IS NULL THEN 'not_found' ELSE 'found' END AS status FROM res")
def whole_profiles(spark, d):
    return reports.profiles(full(spark, d), asked(spark, d))


@query(f"""WITH {_REG}, {_WANTED}, {_BEST} SELECT asked AS identifier, coalesce(merchant_name, '') AS merchant, coalesce(json_extract_string(raw_data, '$."DEALER ACCOUNT NO"'), '') AS answer,
    CASE WHEN id IS NULL THEN 'not_found' ELSE 'found' END AS status FROM res""")
def settlement_accounts(spark, d):
    return reports.raw_report(full(spark, d), asked(spark, d), "settlement_account")


_TERMINALS = "wanted AS (SELECT DISTINCT lpad((s_suppkey * 2)::VARCHAR, 8, '0') AS value FROM supplier)"
_STATICS = """first AS (SELECT value, arg_min(id, (id)) AS id FROM wanted JOIN reg ON tid = value GROUP BY value), f AS (SELECT value, mxcode AS mx, merchant_name AS m, reg.id IS NOT NULL AS known FROM wanted LEFT JOIN first USING (value) LEFT JOIN reg USING (id)),
    s AS (SELECT id, tid, mxcode, merchant_name, static_acc_no, payable_code, alias, sheet_name LIKE '%static_account_terminal%' AS qtb FROM reg WHERE static_acc_no <> ''),
    o AS (SELECT f.value, s.*, rank() OVER (PARTITION BY f.value ORDER BY NOT qtb) AS r FROM f JOIN s ON s.tid = f.value),
    found AS (SELECT value, mxcode, merchant_name, static_acc_no, payable_code, alias FROM o WHERE r = 1 UNION ALL SELECT f.value, s.mxcode, s.merchant_name, static_acc_no, payable_code, alias FROM f JOIN s ON s.mxcode = f.mx WHERE f.mx <> '' AND f.value NOT IN (SELECT value FROM o))"""


@query(f"""WITH {_REG}, {_TERMINALS}, {_STATICS} SELECT DISTINCT value AS identifier, mxcode, merchant_name AS beneficiary, static_acc_no, payable_code, alias, 'found' AS status FROM found
    UNION ALL SELECT value, coalesce(mx, ''), coalesce(m, ''), '', '', '', CASE WHEN known THEN 'no_static_account' ELSE 'not_found' END FROM f WHERE value NOT IN (SELECT value FROM found)""")
def static_accounts(spark, d):
    return reports.static_accounts(full(spark, d), _table(spark, d, "supplier").selectExpr("lpad(cast(s_suppkey * 2 as string), 8, '0') as value").distinct())


@query(f"""WITH {_REG}, w AS (SELECT DISTINCT lpad((s_suppkey * 3 + 5000000)::VARCHAR, 10, '0') AS value FROM supplier UNION SELECT DISTINCT lpad((s_suppkey + 1000000)::VARCHAR, 10, '0') FROM supplier)
    SELECT DISTINCT value, id, merchant_name AS beneficiary, static_acc_no FROM reg JOIN w ON value = static_acc_no OR value = account_number WHERE static_acc_no <> ''""")
def accounts_found(spark, d):
    keys = _table(spark, d, "supplier").selectExpr("explode(array(lpad(cast(s_suppkey * 3 + 5000000 as string), 10, '0'), lpad(cast(s_suppkey + 1000000 as string), 10, '0'))) as value")
    return reports.by_account(full(spark, d), keys)


@query(f"""WITH {_REG} SELECT tid, arg_min(id, (mxcode = '', id)) AS id, arg_min(mxcode, (mxcode = '', id)) AS mxcode, arg_min(merchant_name, (mxcode = '', id)) AS merchant_name, arg_min(address, (mxcode = '', id)) AS address
    FROM reg WHERE (contains(upper(merchant_name), '0042') OR contains(upper(sheet_name), '0042')) AND tid <> '' GROUP BY tid""")
def terminals_of_name(spark, d):
    return reports.terminals_of(full(spark, d), "0042")


_ADDRESS = "s_suppkey || ' market building road, nation_' || s_nationkey || ', lekki'"


@query(f"""WITH {_REG}, w AS (SELECT DISTINCT {_ADDRESS} AS value FROM supplier), q AS (SELECT value, list_distinct(list_filter(regexp_split_to_array(upper(value), '[^A-Z0-9]+'), lambda x: length(x) >= 3 AND x <> 'LEKKI')) AS q FROM w),
    a AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(upper(address), '[^A-Z0-9]+'), lambda x: x <> '')) AS a FROM reg WHERE address <> ''),
    p AS (SELECT value, id, tid, merchant_name, address, len(list_intersect(q, a))::BIGINT AS shared, len(list_distinct(list_concat(q, a))) AS either FROM q, a WHERE len(q) >= 2),
    n AS (SELECT *, round(shared / either, 6) AS ratio FROM p WHERE shared >= 2 AND shared / either >= 0.4),
    o AS (SELECT *, row_number() OVER (PARTITION BY value, CASE WHEN tid <> '' THEN tid ELSE '#' || id END ORDER BY ratio DESC, shared DESC, id) AS k FROM n),
    b AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY ratio DESC, shared DESC, id) AS r FROM o WHERE k = 1) SELECT value, id, tid, merchant_name, address, shared, ratio FROM b WHERE r <= 4""")
def address_answers(spark, d):
    return reports.by_address(full(spark, d), _table(spark, d, "supplier").selectExpr("concat(s_suppkey, ' market building road, nation_', s_nationkey, ', lekki') as value"))


_HANDLES = "unnest(['mxcode', 'tid', 'merchant_name']) AS kind, upper(trim(unnest([mxcode, tid, merchant_name]))) AS key"
_CHANGED = f"""h AS (SELECT asked, {_HANDLES} FROM res WHERE id IS NOT NULL), c AS (SELECT * FROM reg WHERE sheet_name LIKE '%Change%'), ch AS (SELECT id, {_HANDLES} FROM c),
    hit AS (SELECT DISTINCT asked, ch.id FROM h JOIN ch USING (kind, key) WHERE key <> '')"""


@query(f"""WITH {_REG}, {_WANTED}, {_BEST}, {_CHANGED} SELECT c.id, asked AS identifier, merchant_name, mxcode, tid, lpad(c.id::VARCHAR, 10, '0') AS old_bank_acc_no, lpad((c.id + 1)::VARCHAR, 10, '0') AS new_bank_acc_no, '057' AS old_bank_code,
    'New ' || account_name AS new_merchant_account_name, true AS changed FROM hit JOIN c USING (id)""")
def change_details(spark, d):
    found = reports.change_details(full(spark, d), asked(spark, d))
    return found.select("id", "identifier", "merchant_name", "mxcode", "tid", "old_bank_acc_no", "new_bank_acc_no", "old_bank_code", "new_merchant_account_name", "changed")


@query(f"""WITH {_REG}, {_WANTED}, {_BEST}, {_CHANGED}, n AS (SELECT asked, unnest([merchant_name, 'New ' || account_name]) AS variant, 'Change-of-details sheet' AS source FROM hit JOIN c USING (id)
    UNION SELECT asked, reg.merchant_name, reg.sheet_name FROM res JOIN reg ON reg.mxcode = res.mxcode WHERE res.mxcode <> '') SELECT DISTINCT asked AS identifier, trim(variant) AS variant, source FROM n WHERE trim(variant) <> ''""")
def former_names(spark, d):
    return reports.former_names(full(spark, d), asked(spark, d))


_SIDE = "lpad((s_suppkey + {})::VARCHAR, 8, '0')"
_COMPARED = [c for c in reports.COMPARED if c in FULL]


@query(f"""WITH {_REG}, pair AS (SELECT {_SIDE.format(0)} AS entity_a, {_SIDE.format(700)} AS entity_b FROM supplier), wanted AS (SELECT entity_a AS value FROM pair UNION SELECT entity_b FROM pair), {_BEST},
    r AS (SELECT asked, [{', '.join(f"coalesce({c}, '')" for c in _COMPARED)}] AS c, list_filter(list_distinct([{', '.join(f"upper(trim({c}))" for c in _COLUMNS)}]), lambda x: x <> '') AS h FROM res)
    SELECT entity_a, entity_b, coalesce(array_to_string(list_sort(list_intersect(a.h, b.h)), ','), '') AS shared, unnest([{', '.join(f"'{c}'" for c in _COMPARED)}]) AS field, unnest(a.c) AS cell_a, unnest(b.c) AS cell_b
    FROM pair JOIN r a ON a.asked = entity_a JOIN r b ON b.asked = entity_b""")
def compared(spark, d):
    pairs = _table(spark, d, "supplier").selectExpr("lpad(cast(s_suppkey as string), 8, '0') as entity_a", "lpad(cast(s_suppkey + 700 as string), 8, '0') as entity_b")
    return reports.compare(full(spark, d), pairs)


@query(f"""WITH {_REG}, {_WANTED}, {_BEST}, keys AS (SELECT DISTINCT asked, unnest([{', '.join(f"upper(trim({c}))" for c in _COLUMNS)}]) AS cell FROM res WHERE id IS NOT NULL)
    SELECT value AS identifier, count(DISTINCT id) AS n FROM wanted LEFT JOIN keys ON asked = value AND keys.cell <> '' LEFT JOIN cells USING (cell) GROUP BY value""")
def linked_counts(spark, d):
    return reports.linked_counts(full(spark, d), asked(spark, d))


@query(f"""WITH {_REG}, {_WANTED}, {_BEST} SELECT asked AS identifier, coalesce(merchant_name, '') AS merchant, coalesce(nullif(email, ''), nullif(phone, ''), '') AS answer, CASE WHEN id IS NULL THEN 'not_found' ELSE 'no_name' END AS status FROM res""")
def merged_steps(spark, d):
    """E-mails, then phones where there is none."""
    steps = [reports.field_report(full(spark, d), asked(spark, d), c).select("identifier", "merchant", "answer", "status") for c in ("email", "phone")]
    return reports.merge_steps(steps)


_FAMILY = "list_filter(list_distinct(regexp_split_to_array(upper(merchant_name), '[^A-Z0-9]+')), lambda x: length(x) >= 2 AND x <> 'LTD' AND x <> 'OF' AND x <> 'BRANCH')"
_LINKED = ("email", "phone", "mxcode", "tid", "payable_code", "account_number", "merchant_id")
_SHAPES = {"email": "contains(v, '@') AND contains(split_part(v, '@', -1), '.')", "phone": "regexp_full_match(v, '(\\+?234|0)[789]\\d{9}')", "mxcode": "regexp_full_match(v, 'MX\\d{4,8}')", "tid": "regexp_full_match(v, '2ISW[A-Z0-9]{4,6}|\\d{8}|\\d{4}[A-Z]\\d{3}')", "payable_code": "regexp_full_match(v, '\\d{7}')", "account_number": "regexp_full_match(v, '\\d{10}')", "merchant_id": "regexp_full_match(v, '2ISW[A-Z0-9]{11}')"}
_GUARD = f"""lv AS (SELECT * FROM (SELECT id, merchant_name, {_FAMILY} AS core, [upper(trim(tid)), upper(trim(mxcode)), upper(trim(merchant_id)), upper(trim(coalesce(account_number, '')))] AS sig, unnest([{', '.join(f"'{c}'" for c in _LINKED)}]) AS field,
        unnest([{', '.join("lower(trim(email))" if c == "email" else f"upper(trim({c}))" for c in _LINKED)}]) AS v FROM reg) WHERE length(coalesce(v, '')) >= 4 AND CASE field {' '.join(f"WHEN '{c}' THEN {x}" for c, x in _SHAPES.items())} END),
    nm AS (SELECT DISTINCT field, v, upper(trim(merchant_name)) AS name, core FROM lv WHERE trim(merchant_name) <> ''), nn AS (SELECT field, v, count(DISTINCT name) AS names FROM nm GROUP BY ALL),
    tok AS (SELECT field, v, count(*) AS k FROM (SELECT DISTINCT field, v, name, unnest(core) AS t FROM nm) GROUP BY field, v, t), common AS (SELECT field, v, max(k) AS k FROM tok GROUP BY ALL),
    specific AS (SELECT DISTINCT field, v FROM lv LEFT JOIN nn USING (field, v) LEFT JOIN common USING (field, v) WHERE coalesce(names, 0) <= 1 OR k = names)"""


@query(f"""WITH {_REG}, {_GUARD} SELECT DISTINCT field, v AS value FROM specific""")
def family_values(spark, d):
    """Values whose names have a word in common (the registry's signatures join no further names)."""
    return families.specific_values(full(spark, d), signatures=False).select("field", "value")


@query(f"""WITH {_REG}, {_GUARD}, ok AS (SELECT lv.id, field, v FROM lv JOIN specific USING (field, v)), seeds AS (SELECT id FROM reg WHERE contains(upper(merchant_name), '00004') ORDER BY id LIMIT 5),
    k AS (SELECT DISTINCT field, v FROM ok JOIN seeds USING (id)) SELECT id, min(field || '=' || v) AS reason FROM ok JOIN k USING (field, v) GROUP BY id""")
def family_members(spark, d):
    return families.family(full(spark, d), families.seeds(full(spark, d), "00004"), signatures=False).select("id", "reason")


@query(f"""WITH {_REG}, w AS (SELECT DISTINCT 'MX' || lpad((s_suppkey * 7 % 1000)::VARCHAR, 5, '0') AS value FROM supplier), s AS (SELECT DISTINCT mxcode, merchant_name, static_acc_no FROM reg WHERE static_acc_no <> ''), k AS (SELECT DISTINCT mxcode FROM reg)
    SELECT value AS identifier, coalesce(trim(merchant_name), '') AS beneficiary, coalesce(static_acc_no, '') AS static_acc_no, CASE WHEN static_acc_no IS NOT NULL THEN 'found' WHEN k.mxcode IS NOT NULL THEN 'no_static_account' ELSE 'not_found' END AS status
    FROM w LEFT JOIN k ON k.mxcode = value LEFT JOIN s ON s.mxcode = value""")
def static_of_codes(spark, d):
    codes = _table(spark, d, "supplier").selectExpr("'MX' || lpad(cast(s_suppkey * 7 % 1000 as string), 5, '0') as value").distinct()
    return reports.static_of_codes(full(spark, d), codes)


@query(f"""WITH {_REG}, {_WANTED}, {_BEST}, f AS (SELECT asked AS identifier, unnest(['fetch_email', 'fetch_phone']) AS step, coalesce(trim(unnest([email, phone])), '') AS answer, id FROM res)
    SELECT identifier, step, answer, CASE WHEN id IS NULL THEN 'not_found' WHEN answer = '' THEN 'no_value' ELSE 'found' END AS status FROM f""")
def plan_answers(spark, d):
    """Two field steps on every identifier asked for, looked up once for both."""
    inputs = asked(spark, d).select(F.lit(1).alias("request"), F.explode(F.array(F.lit("fetch_email"), F.lit("fetch_phone"), F.lit("rank_top"))).alias("step"), F.lit("tid").alias("kind"), "value", F.lit(False).alias("chained"))
    return execution.field_answers(full(spark, d), inputs, "request").select("identifier", "step", "answer", "status")
