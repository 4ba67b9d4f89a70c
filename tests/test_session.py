"""Where working files go."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from granary import session


def fake(master: str, named: str | None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: named or default),
        sparkContext=SimpleNamespace(master=master),
    )


def test_the_named_folder_wins():
    assert session.shared_dir(fake("yarn", "hdfs://x/check/")) == "hdfs://x/check"
    assert session.fresh_dir(fake("yarn", "hdfs://x"), "a").startswith("hdfs://x/granary/a-")


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        session.shared_dir(fake("spark://host:7077", None))


def test_one_temporary_folder_in_a_bare_local_session():
    first = session.shared_dir(fake("local[2]", None))
    assert first == session.shared_dir(fake("local[*]", None))
