"""Pages of hosts without an inner dot, and of hosts with a dot at their end."""

from skyqa.llm import language


def test_one_row_per_page_of_dotless_hosts(spark, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    texts = [("en", "the house and the garden with this thing"), ("de", "das haus und der garten mit dem ding")]
    names, model = language.train(spark.createDataFrame(texts * 5, "lang string, text string"))
    hosts = ["localhost", "intranet", "intranet:8080", "example.com.", "example.com", "www.example.com.", "a..com", "."]
    rows = [(10 * h + i, f"http://{host}/{i}", f"<p>{texts[i % 2 if host == 'localhost' else 0][1]}</p>") for h, host in enumerate(hosts) for i in range(4)]
    rows += [(900, None, None), (901, "http://localhost", ""), (902, "http://intranet.?q", "")]
    got = language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), names, model).collect()
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows)
    by = {r.page_id: r for r in got}
    assert by[902].language == "en"  # as the other pages of that host
    assert by[30].probability == by[40].probability  # one host with and without the dot at its end
