import pytest

from tidelog.config import DurableMode, FastMode, GroupMode, LogLimits, RelayConfig, SenderConfig, resolve_mode
from tidelog.errors import ConfigError

SENDER = dict(host="h", relay_topic="r", delivery_ack_topic="a", log_path="/x")
RELAY = dict(source_host="s", destination_host="d", relay_topic="r", delivery_ack_topic="a")


def test_defaults():
    assert resolve_mode(None) == FastMode(10_000, 33_554_432, 0.75, 5.0, 3.0, 1_000, 4_194_304)
    assert GroupMode() == GroupMode(20, 0.25, 65536, 50, 1.0)
    assert resolve_mode(DurableMode()) == DurableMode() and LogLimits() == LogLimits(8_388_608, 10_000)
    c = SenderConfig(**SENDER)
    assert (c.port, c.keepalive, c.retry_interval, c.delivery_ack_timeout, c.puback_timeout, c.reconnect_min_delay, c.reconnect_max_delay) == (1883, 60, 10.0, 3.0, 2.0, 1.0, 60.0)
    r = RelayConfig(**RELAY)
    assert (r.destination_publish_timeout, r.source_ack_publish_timeout, r.max_queue_size) == (2.0, 0.5, 1_000)


@pytest.mark.parametrize("bad", [
    dict(host=""), dict(host=" h"), dict(port=0), dict(port=True), dict(port=65536), dict(relay_topic="a/+"), dict(delivery_ack_topic="r"), dict(qos=0), dict(qos=True),
    dict(keepalive=0), dict(retry_interval=0), dict(retry_interval=float("nan")), dict(reconnect_min_delay=9.0, reconnect_max_delay=3.0), dict(debug=1), dict(log_path=""), dict(client_id=""),
])
def test_sender_rejects(bad):
    with pytest.raises(ConfigError):
        SenderConfig(**SENDER | bad)


@pytest.mark.parametrize("bad", [dict(max_queue_size=0), dict(destination_publish_timeout=-1), dict(destination_host="s", source_client_id="x", destination_client_id="x"), dict(relay_topic="\0")])
def test_relay_rejects(bad):
    with pytest.raises(ConfigError):
        RelayConfig(**RELAY | bad)


@pytest.mark.parametrize("make", [
    lambda: GroupMode(None, None, None), lambda: GroupMode(ack_checkpoint_messages=None, ack_checkpoint_interval=None), lambda: GroupMode(sync_messages=0), lambda: GroupMode(sync_interval=0),
    lambda: FastMode(high_watermark=1.1), lambda: FastMode(high_watermark=0), lambda: FastMode(ram_max_messages=1.5), lambda: FastMode(disconnect_grace=-1), lambda: resolve_mode("fast"), lambda: LogLimits(0),
])
def test_modes_reject(make):
    with pytest.raises(ConfigError):
        make()


def test_frozen_and_zero_grace():
    assert FastMode(disconnect_grace=0).disconnect_grace == 0
    with pytest.raises(AttributeError):
        GroupMode().sync_messages = 3
