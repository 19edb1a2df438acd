"""Sources and sinks: files, site maps, navigation, configuration, stores."""
