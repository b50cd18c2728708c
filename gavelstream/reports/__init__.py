"""Reports of benchmark runs, and the dashboard's queries over them."""
