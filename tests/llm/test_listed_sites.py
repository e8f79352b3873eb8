from moraine.llm import urls


def test_listed_names_under_any_ending_and_subdomain(spark):
    hosts = ["casino-win.example.org", "blog.adult-x.example.com", "ads-track.example.org", "m.ads-track.example.com", "a.b.spam-farm.net:8080", "WWW.Free-Bets.example.net", "cheap-pills.example.com"]
    others = ["my-ads-track.example.org", "example.org", "spam-farm", "good.example.com", "x.com:80/ads-track.example.org"]
    pages = spark.createDataFrame([(i, f"http://{h}/p{i}") for i, h in enumerate(hosts + others)] + [(99, None)], "page_id long, url string")
    assert sorted(r.url.rsplit("/p", 1)[1] for r in urls.listed_names(pages).collect()) == [str(i) for i in range(len(hosts))]
    blocked = urls.judge(pages, urls.listed_names(pages), rules=()).filter("verdict = 'block'").select("row.page_id").collect()
    assert sorted(r.page_id for r in blocked) == list(range(len(hosts)))
