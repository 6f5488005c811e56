"""adapterlens: catalogue fine-tuning adapters and screen them for tampering, as Spark jobs."""
