import random

import pytest

from ledgerlife.operators import dtu

T = "2021-11-15"


def mix(make, rows, kyc, **options):
    return dtu.dtu_type_mix(make.trades(rows), make.kyc(kyc), days=[T], **options).first()


def test_type_edges(make):
    firsts = {1: "2021-08-17", 2: "2021-08-18", 3: "2021-11-14", 4: T}  # T-90, T-89, T-1, T
    rows = [(p, d) for p, d in firsts.items()] + [(p, T) for p in firsts]
    row = mix(make, rows, [1, 2, 3, 4])
    assert (row.users, row.type1, row.type2, row.type3) == (4, 1, 2, 1)


def test_day_without_users_gives_no_row(make):
    assert dtu.dtu_type_mix(make.trades([(1, T)]), make.kyc([1]), days=["2021-11-16"]).isEmpty()


def test_return_bands(make):
    rows = [(p, T) for p in range(1, 6)] + [(1, "2021-11-16"), (2, "2021-11-17"), (2, "2021-11-22"), (3, "2021-11-23"),
                                              (4, "2021-12-15"), (5, "2021-12-16")]
    row = dtu.dtu_return_rate(make.trades(rows), make.kyc([1, 2, 3, 4, 5]), days=[T]).first()
    assert (row.users, row.t1, row.t7, row.t30) == (5, 1, 1, 2)
    assert (row.t1_pct, row.t7_pct, row.t30_pct) == (20.0, 20.0, 40.0)


@pytest.fixture(scope="module")
def busy(make):
    rng = random.Random(3)
    rows = []
    for party in range(40):
        for n in range(60):
            if rng.random() < 0.3:
                rows.append((party, f"2021-{11 if n < 30 else 12}-{1 + n % 30:02d}"))
    return make.trades(rows), make.kyc(list(range(30)))


def test_shares_sum_to_hundred_and_days_agree(busy, spark):
    trades, kyc = busy
    every = {r.sauda_date: r for r in dtu.dtu_profile(trades, kyc, old_after=10).collect()}
    for row in every.values():
        assert abs(row.type1_pct + row.type2_pct + row.type3_pct - 100) < 0.03
    some = dtu.dtu_profile(trades, kyc, days=[T, "2021-11-20"], old_after=10).collect()
    assert {r.sauda_date: r for r in some} == {d: every[d] for d in every if str(d) in (T, "2021-11-20")}
    asked = spark.createDataFrame([(T,)], "d string")
    assert dtu.dtu_profile(trades, kyc, days=asked, old_after=10).collect() == [r for r in some if str(r.sauda_date) == T]


def test_profile_agrees_with_the_single_views(busy):
    trades, kyc = busy
    types = {r.sauda_date: r for r in dtu.dtu_type_mix(trades, kyc).collect()}
    returns = {r.sauda_date: r for r in dtu.dtu_return_rate(trades, kyc).collect()}
    for row in dtu.dtu_profile(trades, kyc).collect():
        assert row.type3_pct == types[row.sauda_date].type3_pct
        assert row.t7_pct == returns[row.sauda_date].t7_pct


def test_trade_day_bands_put_non_returners_in_the_first(make):
    later = [f"2021-11-{d}" for d in range(16, 30)]
    rows = [(p, T) for p in (1, 2, 3, 4)] + [(2, later[0])] + [(3, d) for d in later[:5]] + [(4, d) for d in later[:11]]
    row = dtu.trade_day_count_mix(make.trades(rows), make.kyc([1, 2, 3, 4]), days=[T]).first()
    assert (row.customer_type, row.users) == ("type3", 4)
    assert (row.pct_1, row.pct_2_5, row.pct_6_10, row.pct_gt_10) == (50.0, 25.0, 0.0, 25.0)
