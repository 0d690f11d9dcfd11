"""Pages that name no article: what all pages of a host share in a slot of its wrapper is template."""

import pytest

from tidewell.llm import wrappers

PAGE = (
    '<html><body><div class="topbar"><ul><li><a href="/">Site menu</a></li><li>Contact</li></ul></div><div class="text"><h1>Title {k}</h1>{more}<p>Body &amp; {k}</p></div>'
    '<div class="legal">Copyright\n of all</div></body></html>'
)


def page(k: int) -> str:
    return PAGE.format(k=k, more="".join(f"<p>More {k} {j}</p>" for j in range(k % 3)))


def wanted(k: int) -> str:
    return "\n\n".join([f"Title {k}", *(f"More {k} {j}" for j in range(k % 3)), f"Body & {k}"])


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").selectExpr("*", "1 AS slot", "'x' AS template", "0 AS pages")
    return {r.page_id: r.text for r in wrappers.extract(df).collect()}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, f"https://shared.example/{k}", page(k)) for k in range(30)]
    rows += [(100 + k, f"https://single{k}.example/", page(k)) for k in range(3)]
    rows += [(200 + k, "https://copies.example/", page(1)) for k in range(30)]
    rows += [(300 + k, "https://named.example/", f"<body><p>Out</p><article><p>Always</p><p>Now {k}</p></article></body>") for k in range(30)]
    rows += [(400, "https://shared.example/null", None), (401, "https://shared.example/empty", ""), (402, "https://shared.example/article", "<article>Contact</article>")]
    return texts(spark, rows)


def test_template_of_a_host_goes(found):
    assert all(found[k] == wanted(k) for k in range(30))


def test_without_other_pages_nothing_is_template(found):
    for k in range(3):
        assert found[100 + k] == "\n\n".join(["Site menu", "Contact", wanted(k), "Copyright of all"])


def test_copies_of_one_page_are_no_evidence(found):
    assert all("Site menu" in found[200 + k] and "Title 1" in found[200 + k] for k in range(30))


def test_a_named_article_keeps_what_its_host_shares(found):
    assert all(found[300 + k] == f"Always\n\nNow {k}" for k in range(30))
    assert found[400] == "" and found[401] == "" and found[402] == "Contact"
