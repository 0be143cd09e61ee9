import pytest

from tidemark.request import parse_request

GOOD = {"stat": "mean", "stat_freq": "daily", "output_freq": "daily", "time_step": 60, "variable": "pr", "save": False, "checkpoint": False}


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({"stat": None}, KeyError), ({"stat_freq": None}, KeyError), ({"variable": None}, KeyError), ({"time_step": None}, KeyError),
        ({"save": None}, KeyError), ({"checkpoint": None}, KeyError), ({"save": True}, KeyError), ({"checkpoint": True}, KeyError),
        ({"stat": "median"}, ValueError), ({"stat_freq": "fortnightly"}, ValueError), ({"output_freq": "hourly"}, ValueError),
        ({"time_step": 7}, ValueError), ({"time_step": 2880}, ValueError), ({"stat": "thresh_exceed"}, AttributeError),
        ({"stat": "thresh_exceed", "thresh_exceed": "5"}, ValueError), ({"stat": "percentile", "percentile_list": [1.5]}, ValueError),
        ({"stat": "percentile", "percentile_list": ["a"]}, ValueError), ({"stat": "percentile", "compression": "x"}, TypeError),
        ({"stat": "iams"}, ValueError), ({"stat": "bias_correction", "output_freq": "monthly"}, ValueError),
        ({"stat_freq": "weekly", "output_freq": "monthly"}, ValueError), ({"stat_freq": "2hourly", "output_freq": "3hourly"}, ValueError),
        ({"stat_freq": "continuous", "output_freq": None}, ValueError),
        ({"stat_freq": "monthly", "output_freq": "monthly", "time_step": 2880}, ValueError), ({"gap_policy": "sometimes"}, ValueError),
        ({"stat": "histogram", "bins": [3, 1]}, ValueError), ({"stat": "histogram", "range": [2, 1]}, ValueError),
    ],
)
def test_bad_requests(change, error):
    request = {k: v for k, v in (GOOD | change).items() if v is not None}
    with pytest.raises(error):
        parse_request(request)


def test_what_is_put_right(caplog):
    assert parse_request({k: v for k, v in GOOD.items() if k != "output_freq"}).output_freq == "daily"
    assert parse_request(GOOD | {"stat_freq": "daily_noon"}).output_freq == "daily_noon"
    assert len(parse_request(GOOD | {"stat": "percentile"}).percentile_list) == 100
    assert parse_request(GOOD | {"stat": "thresh_exceed", "thresh_exceed": 3}).thresh_exceed == [3]
    assert parse_request(GOOD | {"stat_freq": "annually", "output_freq": "annually"}).stat_freq == "yearly"
    assert len(caplog.records) >= 4


def test_sources(tmp_path):
    (tmp_path / "r.yml").write_text("\n".join(f"{k}: {str(v).lower() if isinstance(v, bool) else v}" for k, v in GOOD.items()))
    try:
        assert parse_request(str(tmp_path / "r.yml")).variable == "pr"
    except ModuleNotFoundError:
        pytest.skip("no YAML reader here")
    with pytest.raises(RuntimeError):
        parse_request(5)
