import json

import numpy as np
import pytest

from latticework.kernels import layers
from latticework.plans import project, provider
from latticework.plans.config import Config


def test_settings():
    s = provider.Settings.resolve({"provider": "openai"}, {"AI_ENABLED": "1", "AI_MODEL": "m"})
    assert (s.enabled, s.provider, s.model) == (True, "openai", "m")
    assert provider.Settings.resolve({}, {"AI_PROVIDER": "local"}).provider == "local" and provider.Settings.resolve({}, {"AI_PROVIDER": "x"}).provider == "mock"
    with pytest.raises(provider.ProviderError):
        provider.Settings.resolve({"provider": "x"}, {})
    with pytest.raises(provider.ProviderError) as e:
        provider.answer_column(provider.Settings(provider="local"), None)
    assert e.value.code == "AI_DISABLED"


def test_understand_asks_once(spark, tmp_path):
    assets = spark.createDataFrame([("a.png", "h1"), ("b.png", "h2"), ("c.png", "h3")], "name string, hash string").coalesce(1)
    cache = provider.AnswerCache(spark, str(tmp_path / "cache"))
    settings = provider.Settings()
    good = json.dumps({"assetType": "monster", "category": "slime", "confidence": 1})
    first = {r.source: r for r in provider.understand(assets, cache, settings, provider.Scripted((good, ValueError("down"), "no json"))).collect()}
    assert [len(first[n].problems) for n in ("a.png", "b.png", "c.png")].count(0) == 1 and not any(r.hit for r in first.values())
    again = provider.understand(assets, cache, settings, provider.Scripted((good,))).collect()
    assert sum(r.hit for r in again) == 2  # the failed call is asked again
    docs = provider.sidecars(provider.understand(assets, provider.AnswerCache(spark, str(tmp_path / "none")), settings), settings)
    docs = {name: "".join(parts) for name, parts in docs.items()}
    assert set(docs) == {"ai_report.json", "classification.json", "asset_metadata.json"}
    for text in docs.values():
        assert text == json.dumps(json.loads(text), indent=2, ensure_ascii=False) + "\n"
    report = json.loads(docs["ai_report.json"])
    assert [r["source"] for r in report["results"]] == ["a.png", "b.png", "c.png"] and set(report["suggestions"]) == {"naming", "pivot", "animation"} and report["errors"] == []
    assert [m["source"] for m in json.loads(docs["asset_metadata.json"])["assets"]] == ["a.png", "b.png", "c.png"]
    (tmp_path / "cache/broken.parquet").write_bytes(b"x")


def test_project():
    image = np.zeros((40, 60, 4), np.uint8)
    image[5:30, 4:25] = (9, 8, 7, 255)
    image[8:33, 32:55] = (1, 2, 3, 255)
    doc, files = project.build("x.png", image, True, Config.default(), step=8, dilation=3)
    assert project.load(json.dumps(doc)) == doc and len(files) == 2
    cells = {v["id"]: layers.extract(image, m, 3)["cell"] for v, (_, m) in zip(doc["layers"], project.box_masks([project.Box(4, 5, 21, 25), project.Box(32, 8, 23, 25)], 40, 60))}
    assert project.check(doc, files, image, cells)["violations"] == 0
    bad = doc | {"projectVersion": 2, "asset": {"source": "", "width": 0, "height": 1}, "mesh": {}, "bones": [{"id": "a", "name": "a", "parent": "b"}, {"id": "b", "name": "b", "parent": "a"}, {"id": "c", "name": "c", "parent": "x"}]}
    assert [p for p, _ in project.problems_of(bad)] == ["projectVersion", "asset.source", "asset.width", "mesh", "bones[c]", "bones[a]", "bones[b]"]


def test_hosted_provider(spark):
    seen = []

    def send(url, headers, body):
        seen.append((url, headers, json.loads(body)))
        return 200, json.dumps({"choices": [{"message": {"content": "```json\n{}\n```"}}]}).encode()

    hosted = provider.Hosted("https://host.example/v1/", "secret", "m-1", send)
    assert hosted.answer("a.png", "look", b"\x89PNG") == "```json\n{}\n```"
    url, headers, body = seen[0]
    assert url == "https://host.example/v1/chat/completions" and headers["authorization"] == "Bearer secret"
    assert body["model"] == "m-1" and [c["type"] for c in body["messages"][0]["content"]] == ["text", "image_url"]
    assert body["messages"][0]["content"][1]["image_url"]["url"] == "data:image/png;base64,iVBORw=="
    for status, said, message in ((500, b"", "HTTP 500"), (200, b"no json", "no message"), (200, b'{"choices": []}', "no message"), (200, b'{"choices": [{"message": {"content": 1}}]}', "no message")):
        with pytest.raises(provider.ProviderError, match=message):
            provider.Hosted("x", "k", "m", lambda *_, r=(status, said): r).answer("a", "p")

    def down(*_):
        raise OSError("no route")

    with pytest.raises(provider.ProviderError, match="request failed: no route"):
        provider.Hosted("x", "k", "m", down).answer("a", "p")
    requests = spark.createDataFrame([("k1", "a.png", bytearray(b"1"))], "key string, name string, png binary")
    ok = provider.Hosted("x", "k", "m", lambda *_: (200, b'{"choices": [{"message": {"content": "yes"}}]}'))
    assert [tuple(r) for r in provider.ask(requests, ok).collect()] == [("k1", "a.png", "yes", None)]
    assert "reserved" in provider.ask(requests.drop("png"), provider.Reserved()).first().error
