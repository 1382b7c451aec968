"""Every registered query of the engine: against its SQL, or that it runs."""

from __future__ import annotations

import pytest
from oracle import both

from hushlake.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    got, wanted = both(spark, QUERIES[name], ORACLES[name], SF)
    assert got == wanted
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).limit(5).collect()


def test_native_scan_agrees_with_the_engine(spark):
    """The built-in expressions and the Python engine find the same, but for IPv6, which only the engine knows."""
    a = {tuple(r) for r in QUERIES["scan_all_native"](spark, SF).drop("n").collect()}
    b = {tuple(r) for r in QUERIES["scan_all_resolved"](spark, SF).drop("n").where("not (kind = 'IP_ADDRESS' and value like '%:%')").collect()}
    assert a == b


def test_vault_is_stable_and_salted(spark):
    from hushlake.catalog import _emails
    from hushlake.operators.vault import Vault

    found = _emails(spark, SF)
    one = {r["value_hmac"]: r["placeholder"] for r in Vault(bytes(32), b"a").assign(found).collect()}
    again = {r["value_hmac"]: r["placeholder"] for r in Vault(bytes(32), b"a").assign(found).collect()}
    other = {r["value_hmac"]: r["placeholder"] for r in Vault(bytes(32), b"b").assign(found).collect()}
    assert one == again and set(one) == set(other)
    assert not set(one.values()) & set(other.values())
    assert all(p.startswith("EMAIL_") and 2**63 <= int(p[6:]) < 2**64 for p in one.values())
    v = Vault(bytes(32), b"a")
    v.verify(v.meta(spark))
    with pytest.raises(ValueError):
        Vault(bytes([1] * 32), b"a").verify(v.meta(spark))
