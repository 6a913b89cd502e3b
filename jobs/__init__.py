"""Jobs over tables of text, each with a command line and a config file of its own."""
