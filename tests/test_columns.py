"""Which column power is read from."""

import pytest

from sunfold.sources.files import canonical


@pytest.mark.parametrize(
    ("columns", "values", "power"),
    [
        ("power_kwh", ("0.5",), 0.5),
        ("Power_kWh", ("bad",), None),
        ("power, power_kwh", ("20", "7"), 20.0),
        ("power, power_kwh", ("0.9", "7"), 900.0),
        ("`Power (MW)`, power_kwh", ("2", "7"), 2000.0),
    ],
)
def test_power_falls_back_on_energy(spark, columns, values, power):
    names = [c.strip().strip("`") for c in columns.split(",")]
    raw = spark.createDataFrame([("2024-01-01 00:00:00", *values)], ["time", *names])
    out = canonical(raw, required=("power",))
    assert out.first()["power"] == power
    assert ("power_kwh" in out.columns) == (len(names) > 1)  # carried unless it is the power


def test_no_power_at_all(spark):
    with pytest.raises(ValueError, match="power"):
        canonical(spark.createDataFrame([("2024-01-01", "1")], ["time", "energy"]), required=("power",))
