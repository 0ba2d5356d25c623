import pytest
import yaml

from pipequery import cli, config

TEXT = """
pipeline:
  batch_size: {{ PIPEQUERY_BATCH|default(1000) }}
  source:
    type: kafka
    kafka: {brokers: [{{ brokers|default('localhost:9092') }}], group_id: g, auto_offset_reset: earliest, topics: [in]}
  handler: {type: handlers.InferredMemBatch, sql: SELECT * FROM batch}
  sink: {type: console}
"""


def parsed(text=TEXT, **environ):
    return config.from_dict(yaml.safe_load(config.render(text, environ=environ)))


def test_variables_default_environment_and_overrides():
    assert parsed().pipeline.batch_size == 1000
    assert parsed(PIPEQUERY_BATCH="7").pipeline.batch_size == 7
    assert parsed(brokers="x:1").pipeline.source.kafka.brokers == ["localhost:9092"]  # only prefixed names are taken
    assert "x:1" in config.render(TEXT, {"brokers": "x:1"}, {})


def test_defaults():
    conf = parsed(TEXT.replace("batch_size: {{ PIPEQUERY_BATCH|default(1000) }}", "name: n"))
    assert (conf.pipeline.batch_size, conf.pipeline.flush_interval_seconds, conf.pipeline.on_error.policy) == (1, 30, config.Policy.RAISE)


def test_mistakes_are_found():
    d = yaml.safe_load(config.render(TEXT, environ={}))
    assert config.validate(d) == []
    assert config.validate({"pipeline": {"x": 1}, "y": 2}) != []
    with pytest.raises(config.ConfigError):
        config.from_dict(d | {"pipeline": d["pipeline"] | {"sink": {"type": "nowhere"}}})
    with pytest.raises(config.ConfigError):
        config.from_dict(d | {"pipeline": d["pipeline"] | {"on_error": {"policy": "DLQ"}}})
    with pytest.raises(NotImplementedError):
        config.from_dict(d | {"pipeline": d["pipeline"] | {"source": {"type": "nowhere"}}})


def test_command_line(tmp_path, capsys):
    good = tmp_path / "a.yml"
    good.write_text(TEXT)
    assert cli.main(["config", "validate", str(good)]) == 0
    good.write_text("pipeline: {}")
    assert cli.main(["config", "validate", str(good)]) == 1
    capsys.readouterr()
    assert cli.main(["config", "example"]) == 0
    assert "batch_size" in yaml.safe_load(capsys.readouterr().out)["pipeline"]


def test_kafka_options():
    from pipequery.sources import kafka_options

    source = config.source_from(
        {"type": "kafka", "kafka": {"brokers": ["a:1", "b:2"], "group_id": "g", "auto_offset_reset": "earliest", "topics": ["t"], "security_protocol": "SASL_SSL",
                                     "sasl": {"mechanism": "SCRAM-SHA-256", "username": "u", "password": "p"}, "ssl": {"ca_location": "/ca", "endpoint_identification_algorithm": "none"}}}
    )
    options = kafka_options(source.kafka, 500)
    assert options["kafka.bootstrap.servers"] == "a:1,b:2" and options["maxOffsetsPerTrigger"] == "500"
    assert "ScramLoginModule" in options["kafka.sasl.jaas.config"] and options["kafka.ssl.endpoint.identification.algorithm"] == ""
