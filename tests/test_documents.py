import pytest

from tidewell.operators import metrics
from tidewell.sources import documents


def test_documents(spark, tmp_path):
    (tmp_path / "r.toml").write_text('[personal]\nname = "A & B"\nemail = "a@example.org"\n[[experience]]\ntitle = "Engineer"\nstart = "2020"\nend = "2021"\ndetails = ["<x>"]\n')
    d = documents.load_toml(str(tmp_path / "r.toml"))
    html = documents.render_html(documents.resumes(spark, [d])).first().html
    assert "<h1>A &amp; B</h1><p>a@example.org</p>" in html and "<b>Engineer</b> <i>2020 - 2021</i><ul><li>&lt;x&gt;</li>" in html
    with pytest.raises(FileNotFoundError):
        documents.load_toml(str(tmp_path / "none.toml"))
    with pytest.raises(ValueError):
        documents.resume({"skills": None})
    assert documents.main([str(tmp_path / "none.toml")]) == 2
    assert documents.main([str(tmp_path / "r.toml"), "--html", str(tmp_path / "r.html")]) == 0 and (tmp_path / "r.html").read_text() == html


def test_missing_metrics_file_is_empty(spark, tmp_path):
    assert metrics.read_csv(spark, f"file://{tmp_path}/none.csv", 2).isEmpty()
    assert metrics.workload(spark, 100, 10, 0.5, 0.3).count() == 100
