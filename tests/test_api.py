import dependra


def test_names():
    for name in dependra.__all__:
        assert getattr(dependra, name) is not None
    assert dependra.gumbel == "gumbel" and "tll" in dependra.all and dependra.bb == ["bb1", "bb6", "bb7", "bb8"]
    for group in ("parametric", "nonparametric", "one_par", "two_par", "three_par", "elliptical", "archimedean", "extreme_value", "rotationless", "lt", "ut", "itau"):
        assert getattr(dependra, group)
    assert dependra.to_pseudo_obs is dependra.pseudo_obs
