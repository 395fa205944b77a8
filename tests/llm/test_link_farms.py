"""Verdicts from the link graph must not depend on how many hosts link alike."""

import pytest

from sievenet.llm import urlgraph


@pytest.mark.parametrize("farm", [1, 2, 60])
def test_link_farm_of_any_size(spark, farm):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    pages = [("spam.net", ""), ("seed.org", "")]
    pages += [(f"farm{k}.io", link("spam.net")) for k in range(farm)]  # only spam
    pages += [(f"far{k}.io", link(f"farm{k}.io")) for k in range(farm)]  # only the farm
    pages += [(f"mixed{k}.io", link("spam.net", *[f"own{k}x{j}.io" for j in range(4)])) for k in range(farm)]  # one of five
    pages += [(f"popular{k}.io", link("spam.net", *[f"popular{j}.com" for j in range(4)])) for k in range(farm)]
    pages += [(f"fan{k}.io", link(*[f"popular{j}.com" for j in range(4)])) for k in range(200)]  # make them popular
    rows = [(i, f"http://{host}/{'fr/' if host == 'seed.org' else ''}", html) for i, (host, html) in enumerate(pages)]
    got = {r.host: r for r in urlgraph.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in range(farm):
        assert [got[f"{name}{k}.io"].verdict for name in ("farm", "far", "mixed", "popular")] == ["block", "block", "allow", "allow"]
    assert got["spam.net"].rule and got["seed.org"].verdict == "allow" and all(got[f"fan{k}.io"].verdict == "allow" for k in range(200))
