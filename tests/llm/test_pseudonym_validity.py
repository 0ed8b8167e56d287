"""Only values that pass their check are replaced and counted."""

from farpoint.llm import pseudonyms
from tests.llm.test_pseudonyms import luhn, new_values


def test_invalid_numbers_and_dates_stay(spark):
    same = ["2123465659789240", "9870157079875996", "at 1700000000001 ms", "4111-1111-1111-1112", "2001-02-30", "30.02.2001", "02/30/2001", "2001/02/30"]
    assert not any(luhn("".join(c for c in v if c.isdigit())) for v in same[:4])
    assert new_values(spark, same) == (same, [0] * len(same))


def test_valid_ones_beside_them_are_replaced(spark):
    old = "card 4111 1111 1111 1111, order 2123465659789240, born 2000-02-29, not 2001-02-29"
    (new,), (count,) = new_values(spark, [old])
    assert count == 2 and "2123465659789240" in new and "2001-02-29" in new
    assert "4111 1111" not in new and "2000-02-29" not in new
    assert luhn("".join(c for c in new.split(",")[0] if c.isdigit()))
    bodies = [f"{4000000000000000 + i * 7919}" for i in range(400)]
    valid = [v for v in bodies if luhn(v)]
    replaced, counts = new_values(spark, valid)
    assert set(counts) == {1} and len(set(replaced)) == len(valid) and all(map(luhn, replaced))
