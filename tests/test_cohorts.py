from ledgerlife.operators import cohorts

from conftest import day


def rate(make, trades, kyc, **options):
    return cohorts.dormancy_rate(make.trades(trades), make.kyc(kyc), "2021-03-31", "2021-01-01", "2021-01-31", **options).first()


def test_sixty_days_is_active_and_sixty_one_dormant(make):
    trades = [(1, "2021-01-05"), (1, "2021-01-30"), (2, "2021-01-05"), (2, "2021-01-29"), (3, "2021-01-02"), (3, "2021-03-30")]
    row = rate(make, trades, [1, 2, 3])
    assert (row.parties, row.dormant, row.dormancy_pct) == (3, 1, 33.33)


def test_only_marked_customers_count_once(make):
    kyc = [1, 1, {"party_code": 2, "B2C": None}, {"party_code": 3, "B2C": "N"}]
    row = rate(make, [(p, "2021-01-05") for p in (1, 2, 3, 4)], kyc)
    assert row.parties == 1


def test_trades_after_the_date_are_not_seen(make):
    row = rate(make, [(1, "2021-01-05"), (1, "2021-04-01"), (2, "2020-12-31"), (2, "2021-01-05")], [1, 2])
    assert (row.parties, row.dormant) == (1, 1)


def test_empty_cohort_has_no_rate(make):
    row = rate(make, [(1, "2020-01-05")], [1])
    assert (row.parties, row.dormancy_pct) == (0, None)


def test_matrix_equals_single_rates(make):
    trades = make.trades(
        [(p, f"2021-{1 + (p * 7 + k * k) % 8:02d}-{1 + (p * 5 + k * 11) % 28:02d}") for p in range(60) for k in range(4)]
    )
    kyc = make.kyc(list(range(50)))
    months = [("2021-01-01", "2021-01-31"), ("2021-02-01", "2021-02-28"), ("2021-03-01", "2021-03-31")]
    dates = ["2021-04-01", "2021-04-02", "2021-04-30", "2021-05-31", "2021-08-31"]
    cells = {(str(r.cohort_start), str(r.as_of)): r for r in cohorts.dormancy_matrix(trades, kyc, months, dates).collect()}
    assert ("2021-01-01", "2021-04-01") not in cells  # exactly 60 days past the cohort's end
    assert ("2021-01-01", "2021-04-02") in cells
    for (low, as_of), cell in cells.items():
        high = dict(months)[low]
        single = cohorts.dormancy_rate(trades, kyc, as_of, low, high).first()
        assert (single.parties, single.dormant, single.dormancy_pct) == (cell.parties, cell.dormant, cell.dormancy_pct)
    grid = cohorts.dormancy_grid(cohorts.dormancy_matrix(trades, kyc, months, dates), dates)
    assert grid.columns == ["cohort_start", *dates]
    first = grid.filter("cohort_start = '2021-01-01'").first()
    assert first["2021-04-01"] is None and first["2021-04-30"] == cells[("2021-01-01", "2021-04-30")].dormancy_pct


def test_first_trade_cohort(make):
    row = cohorts.first_trade_cohort(make.trades([(1, "2021-01-05"), (1, "2021-03-09"), (1, "2021-02-01")])).first()
    assert (row.first_trade, row.last_trade, row.activation_month) == (day("2021-01-05"), day("2021-03-09"), day("2021-01-01"))
