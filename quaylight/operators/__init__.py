"""DataFrame operators over events, log entries, metric samples, alerts and deliveries."""
