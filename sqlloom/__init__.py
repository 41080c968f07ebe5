"""SQL contracts on Spark: plain ``.sql`` files described through Catalyst."""
