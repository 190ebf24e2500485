import pytest

from ledgerlife.operators import states

from conftest import day

FLAGS = {"has_cnc_trade": ["EQ"], "has_fut_idx_trade": ["FUT"]}


@pytest.fixture(scope="module")
def summary(make):
    rows = [(1, "2022-01-01", "EQ"), (1, "2022-01-01", "FUT"), (1, "2022-01-05"), (1, "2022-01-20"), (1, "2022-01-31"), (1, "2022-02-01"),
            (2, "2022-01-10"), (2, "2022-04-20")]
    return states.daily_summary(make.trades(rows), FLAGS)


def test_daily_summary(summary):
    rows = {(r.party_code, str(r.sauda_date)): r for r in summary.collect()}
    first = rows[1, "2022-01-01"]
    assert (first.cumulative_trade_days, first.average_gap_last_four_trades_weeks) == (1, None)
    assert (first.average_gap_last_four_trades_label, first.has_cnc_trade, first.has_fut_idx_trade) == ("Other", 1, 1)
    last = rows[1, "2022-02-01"]
    assert last.cumulative_trade_days == 5
    assert last.average_gap_last_four_trades_weeks == pytest.approx((4 + 15 + 11 + 1) / 4 / 7)
    assert last.average_gap_last_four_trades_label == "TwoWeeks"
    assert rows[2, "2022-04-20"].average_gap_last_four_trades_label == "Other"


def test_targets_look_thirty_days_ahead_or_over_the_range(summary):
    def targets(**options):
        return {(r.party_code, str(r.sauda_date)): r for r in states.transition_targets(summary, **options).collect()}

    ahead, whole = targets(), targets(horizon_days=None)
    # 31 January is the 30th day after the first trade, 1 February the 31st.
    assert ahead[1, "2022-01-01"].target_trade_days == 4 and whole[1, "2022-01-01"].target_trade_days == 5
    assert (ahead[2, "2022-01-10"].settle_target, whole[2, "2022-01-10"].settle_target) == (0, 1)
    assert (ahead[1, "2022-01-01"].settle_target, ahead[1, "2022-01-01"].frequent_target) == (2, 1)
    assert ahead[2, "2022-04-20"].frequent_target == 0 and ahead[2, "2022-01-10"].frequent_target is None
    cut = targets(end="2022-01-20")
    assert cut[1, "2022-01-01"].target_trade_days == 3 and (1, "2022-01-31") not in cut


def test_states_and_transitions(summary, make):
    dates = ["2021-12-31", "2022-01-01", "2022-01-20", "2022-02-05", "2022-02-20", "2022-04-30", "2022-08-01"]
    kyc = make.kyc([1, 2, 3])
    found = states.user_state(summary, dates, kyc)
    by = {(r.party_code, str(r.as_of)): r.state for r in found.collect()}
    assert [by[1, d] for d in dates] == ["KYC", "First Sauda", "Settling-In", "Frequent W-r", "Frequent M-r", "Frequent Q-r", "Dormant"]
    assert by[2, "2022-04-30"] == "Settling-In" and by[3, "2022-08-01"] == "KYC"
    moves = states.state_transitions(summary, dates, kyc).collect()
    for i, d in enumerate(dates[:-1]):
        assert sum(r.parties for r in moves if str(r.as_of) == d) == 3
        assert {str(r.next_as_of) for r in moves if str(r.as_of) == d} == {dates[i + 1]}
    step = [r for r in moves if str(r.as_of) == "2021-12-31" and r.next_state == "First Sauda"]
    assert [(r.state, r.parties) for r in step] == [("KYC", 1)]


def test_states_without_customers_leave_out_strangers(summary):
    assert states.user_state(summary, ["2022-02-05"]).count() == 2


def test_day_type(summary):
    assert summary.filter(summary.sauda_date == day("2022-01-01")).count() == 1
