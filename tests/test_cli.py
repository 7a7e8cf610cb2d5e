"""From text files to answers and metrics, end to end."""

from paperloom import cli, config
from paperloom.sources import providers
from tests.conftest import rows

TOPICS = ["zinc transport in liver cells", "membrane fusion in yeast cultures", "axon guidance in the retina"]


def test_build_ask_evaluate(spark, tmp_path):
    for i, topic in enumerate(TOPICS):
        body = " ".join(f"We found that TP5{i} increases and activates {topic} in sample {k}." for k in range(25))
        (tmp_path / f"paper{i}.txt").write_text(f"A study of {topic} by several groups\nAbstract\n{body}\nResults\n{body}\nReferences\n[1] Nobody.\n")
    out = str(tmp_path / "out")
    summary = cli.build(spark, str(tmp_path), out).first()
    assert summary["papers"] == 3 and summary["total_chunks"] == 6
    context = cli.ask(spark, out, ["What about membrane fusion in yeast?"]).first()["context"]
    assert "membrane fusion" in context
    prompts = []
    lines = ["What about zinc transport?", "", "And axon guidance?", "clear", "Again?", "quit", "never asked"]
    replies = list(cli.session(spark, out, lines, call=lambda p: prompts.append(p) or f"answer {len(prompts)}"))
    assert replies == ["answer 1", "answer 2", "History cleared.", "answer 3"]
    assert "user: What about zinc transport?\n\nassistant: answer 1\n\nuser: And axon guidance?" in prompts[1] and "answer" not in prompts[2]
    assert len(context.split()) > 40 > len(cli.ask(spark, out, ["What about membrane fusion in yeast?"], config.Settings(target_tokens=30)).first()["context"].split())
    assert cli.golden(spark, out, f"{out}/golden", 4).count() == 4
    report = cli.evaluate(spark, out, f"{out}/golden", ablation=False)
    assert rows(report.select("config", "k").distinct())[0] == ("full", 1) and report.count() == 4


def test_providers(spark):
    tried = []

    def limited(prompt):
        tried.append(prompt)
        if len(tried) < 2:
            raise providers.RateLimited
        return "yes"

    assert providers.answer("p", limited, sleep=lambda s: None) == "yes" and len(tried) == 2
    assert providers.answer("p", lambda p: 1 / 0) is None

    def connect():
        def call(prompt):
            if prompt == "stop":
                raise providers.Refused
            return prompt.upper()

        return call

    df = spark.createDataFrame([(1, "a"), (2, "stop"), (3, "b")], "key int, prompt string").coalesce(1)
    assert rows(providers.answers(df, connect)) == [(1, "A"), (2, None), (3, None)]
    assert "".join(providers.pieces("some answer", 4)) == "some answer"
