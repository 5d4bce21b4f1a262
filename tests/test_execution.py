"""Plans run over a small registry."""

from __future__ import annotations

from rollbook.operators import execution

REGISTRY = [
    (1, "m.xlsx :: a", "RED SUN", "10000001", "MX10001", "a@x.com", "", "", "", ""), (2, "qtb.xlsx :: static_account_terminal", "RED SUN", "", "MX10001", "", "", "1111111111", "", ""), (3, "m.xlsx :: a", "BLUE", "10000003", "MX10003", "", "08031000003", "", "", ""),
]


def test_plans_are_run(spark):
    df = spark.createDataFrame(REGISTRY, "id bigint, sheet_name string, merchant_name string, tid string, mxcode string, email string, phone string, static_acc_no string, payable_code string, alias string")
    steps = spark.createDataFrame([(1, "fetch_email", []), (1, "fetch_phone", []), (2, "resolve_mxcode", []), (2, "fetch_static_account", ["resolve_mxcode"]), (3, "fetch_static_account", ["resolve_mxcode"]), (4, "rank_top", []), (5, "fetch_email", [])], "id int, step string, requires array<string>")
    given = spark.createDataFrame([(1, "tid", "10000001"), (1, "tid", "10000003"), (1, "tid", "99999999"), (2, "tid", "10000001"), (3, "mxcode", "MX10003"), (4, "tid", "10000001"), (5, "tid", None), (5, "tid", "")], "id int, kind string, value string")
    got = sorted(map(tuple, execution.run(df, steps, given, "id").collect()))
    assert [r for r in got if r[0] == 1] == [
        (1, "fetch_email", "10000001", "a@x.com", "found", False), (1, "fetch_email", "10000003", "", "no_value", False), (1, "fetch_email", "99999999", "", "not_found", False),
        (1, "fetch_phone", "10000001", "", "no_value", False), (1, "fetch_phone", "10000003", "08031000003", "found", False), (1, "fetch_phone", "99999999", "", "not_found", False),
    ]
    assert (2, "resolve_mxcode", "10000001", "MX10001", "found", False) in got
    assert (2, "fetch_static_account", "MX10001", "1111111111", "found", True) in got
    assert [r[3:5] for r in got if r[0] == 3] == [("", "no_static_account")]
    assert not [r for r in got if r[0] in (4, 5)] and not execution.run(df, steps.limit(0), given, "id").collect()
