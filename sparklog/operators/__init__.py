"""DataFrame operators. They build plans; none of them collects log rows."""
