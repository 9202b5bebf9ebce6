"""Rules, their runner and the reports made of their findings."""
