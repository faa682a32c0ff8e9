import pytest

from pitchloom.params import require_registered


def test_experiments_need_fixed_parameters():
    require_registered(a=1, b=0)
    with pytest.raises(ValueError, match="b, c"):
        require_registered(a=1, b=None, c=None)
